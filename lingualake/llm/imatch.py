"""I-Match document fingerprints: hashes of the sorted terms that fall in a band of document frequency.

The lexicon holds the terms that occur in a share of the documents between LOW and HIGH; where more than
LEXICON terms could lie in that band its lower edge is higher, set from the terms' counts, so the lexicon is
small whatever the corpus. It is
packed into one row and handed to every task. A fingerprint is the hash of all of a text's lexicon terms
and, for several scales, of its terms in each of some randomised lexicon subsets of one in 8 to
65536 terms; the sparsest serves texts of any size. Likeness is the share of agreeing subsets, at the finest scale that the two texts populate.

Documents are put in order of their ids in blocks between quantiles of the ids: each block also gets the
first row of the block that follows, so one shuffle of the texts serves and no window spans the table.
Everything is DataFrame functions.

Cases: a null text counts as empty; texts without any term have the fingerprint of no terms. Texts with
no lexicon term are hashed over all their terms. Rows that share an id are ordered by text. Rows
without an id have no next document: nothing replaces the end of their text and near_next is null. The
only document is its own next one. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_or_empty

LOW, HIGH = 0.002, 0.05
LEXICON = 200_000
#: (one in so many terms, so many subsets), coarse to fine.
SCALES = ((8, 8), (64, 16), (256, 32), (1024, 32), (4096, 32), (16384, 32), (65536, 32))
#: A scale serves texts of at most so many times as many terms; the last one has no limit.
DENSE = 8
#: The scales from LARGE on serve only texts of at least one term for so many of theirs: smaller ones can't populate them.
LARGE, SPARSE = 4, 64
#: Subsets that two texts must populate for a scale to tell.
POPULATED = 6
EMPTY = "d41d"  # the start of the hash of no terms
BUCKETS = 1 << 12
BLOCK_ROWS = 512
FAN = 256


def terms(text: Column) -> Column:
    """A text's distinct lower-case runs of letters and digits."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(rows: DataFrame, text: Column, n: int) -> DataFrame:
    """One row `lexicon`: in BUCKETS lists, the hashes of the terms inside the band of the `n` rows.

    The terms of a share LOW or more have `total` places in documents between them, so at most LEXICON of
    them can have total / LEXICON places or more each: that is the band's lower edge where it is above LOW.
    """
    counts = rows.select(F.explode(terms(text)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    band = staged(counts.filter(F.col("n").between(max(2.0, LOW * n), HIGH * n)))
    total = band.agg(F.sum("n")).first()[0] or 0
    hashed = band.filter(F.col("n") >= total / LEXICON).select(F.xxhash64("term").alias("h")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    lists = hashed.groupBy("bucket").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    every = rows.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(lists, "bucket", "left")
    packed = F.transform(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("hs", F.array().cast("array<bigint>")).alias("hs")))), lambda x: x["hs"])
    return staged(every.agg(packed.alias("lexicon")))


def _inside(s: int) -> Column:
    """(subset, term) of the hashed terms in the subsets that scale `s` uses; none if the text has too many or few terms for it."""
    every, subsets = SCALES[s]
    parts = F.transform("_hashed", lambda x: F.struct(F.pmod(F.shiftright(x["h"], 5 * s), F.lit(every)).cast("int").alias("p"), x["t"].alias("t")))
    served = F.size("_hashed") <= DENSE * every if s < len(SCALES) - 1 else F.lit(True)
    served = served & (F.size("_hashed") * SPARSE >= every) if s >= LARGE else served
    return F.when(served, F.filter(parts, lambda x: x["p"] < subsets)).otherwise(F.array().cast("array<struct<p:int,t:string>>"))


def _hashes(s: int) -> Column:
    """The beginning of the hash of each subset's terms."""
    chosen = lambda i: F.transform(F.filter(F.col(f"_scale{s}"), lambda x: x["p"] == i), lambda x: x["t"])
    return F.transform(F.sequence(F.lit(0), F.lit(SCALES[s][1] - 1)), lambda i: F.substring(F.md5(F.array_join(chosen(i), " ").cast("binary")), 1, 4))


def with_fingerprint(df: DataFrame, text: str, name: str, words: DataFrame) -> DataFrame:
    """`df` with `name`, under the lexicon `words`: an array of arrays of hash beginnings, one for each of SCALES (empty if one from LARGE on is not populated), and `name`_all, the hash over all terms."""
    inside = lambda t: F.array_contains(F.element_at(F.col("_lexicon"), (F.pmod(F.xxhash64(t), F.lit(BUCKETS)) + 1).cast("int")), F.xxhash64(t))
    out = df.withColumn("_terms", terms(F.col(text)))
    out = out.withColumn("_lexicon", words.scalar()).withColumn("_band", F.filter("_terms", inside)).drop("_lexicon")
    out = out.withColumn("_kept", F.sort_array(F.when(F.size("_band") > 0, F.col("_band")).otherwise(F.col("_terms")))).drop("_terms", "_band")
    out = out.withColumn("_hashed", F.transform("_kept", lambda t: F.struct(F.conv(F.substring(F.md5(t.cast("binary")), 1, 15), 16, 10).cast("bigint").alias("h"), t.alias("t"))))
    out = out.withColumns({f"_scale{s}": _inside(s) for s in range(len(SCALES))})
    parts = [F.when(F.size(f"_scale{s}") > 0, _hashes(s)).otherwise(F.array_repeat(F.lit(EMPTY), SCALES[s][1] if s < LARGE else 0)) for s in range(len(SCALES))]
    whole = F.md5(F.array_join("_kept", " ").cast("binary"))
    return out.withColumns({name: F.array(*parts), f"{name}_all": whole}).drop("_kept", "_hashed", *(f"_scale{s}" for s in range(len(SCALES))))


def as_text(name: str) -> Column:
    empty = F.array(*(F.lit(EMPTY * subsets) for _, subsets in SCALES))
    parts = F.zip_with(name, empty, lambda x, e: F.when(F.size(x) > 0, F.array_join(x, "")).otherwise(e))
    return F.concat(F.col(f"{name}_all"), F.array_join(parts, ""))


def likeness(left: str, right: str) -> Column:
    """From 0 to 1: the share of agreeing subsets at the finest scale of which POPULATED are populated by either, 1 for equal terms."""
    out = None
    for s in range(len(SCALES)):
        a, b = F.col(left)[s], F.col(right)[s]
        agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != EMPTY)), lambda x: x)).cast("double")
        used = F.size(F.filter(F.zip_with(a, b, lambda x, y: (F.coalesce(x, F.lit(EMPTY)) != EMPTY) | (F.coalesce(y, F.lit(EMPTY)) != EMPTY)), lambda x: x))
        share = agree / F.greatest(used, F.lit(1))
        out = share if out is None else F.when(used >= POPULATED, share).otherwise(out)
    return F.when(F.col(f"{left}_all") == F.col(f"{right}_all"), 1.0).otherwise(out)


def _once(df: DataFrame) -> DataFrame:
    """`df`, out of the reach of later filters and projections, which would repeat its nested expressions."""
    return df.select(F.inline(F.array(F.struct("*"))))


def _edges(rows: DataFrame, n: int) -> DataFrame:
    """One row `edges`: ids that cut the table in blocks of about BLOCK_ROWS, in lists of FAN; at most FAN lists, so blocks grow beyond FAN * FAN."""
    blocks = min(max(1, -(-n // BLOCK_ROWS)), FAN * FAN)
    shares = F.split(F.lit(",".join(str(k / blocks) for k in range(blocks))), ",").cast("array<double>")
    cuts = rows.agg(F.percentile_approx("id", shares, F.lit(max(10_000, 10 * blocks))).alias("cuts"))
    cuts = cuts.select(F.array_sort(F.array_distinct(F.coalesce("cuts", F.array().cast("array<bigint>")))).alias("cuts"))
    lists = F.transform(F.sequence(F.lit(0), F.lit((blocks - 1) // FAN)), lambda i: F.slice("cuts", i * FAN + 1, F.lit(FAN)))
    return staged(cuts.select(F.filter(lists, lambda x: F.size(x) > 0).alias("edges")))


def _in_blocks(rows: DataFrame, n: int) -> DataFrame:
    """`rows` (id, text) with block and copy: each block also has a copy of the row that comes after it in descending order of ids."""
    below = lambda xs, first: F.size(F.filter(xs, lambda x: first(x) <= F.col("id")))
    outer = below(F.col("_edges"), lambda x: x[0])
    inner = below(F.get("_edges", F.greatest(F.col("_outer") - 1, F.lit(0))), lambda x: x)
    found = rows.withColumn("_edges", _edges(rows, n).scalar()).withColumn("_outer", outer)
    found = found.withColumn("block", F.when(F.col("_outer") > 0, (F.col("_outer") - 1) * FAN + inner).otherwise(0).cast("bigint")).drop("_edges", "_outer")
    blocked = found.withColumn("block", F.when(F.col("id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(1024))).otherwise(F.col("block")))
    heads = staged(blocked.filter("id is not null").groupBy("block").agg(F.max("id").alias("id")))  # at most FAN * FAN + 1 rows
    order = Window.orderBy("block")
    links = heads.select("id", F.coalesce(F.lead("block").over(order), F.min("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    copies = rows.join(F.broadcast(links), "id").groupBy("id", "to").agg(F.min("text").alias("text"))
    return blocked.withColumn("copy", F.lit(False)).unionByName(copies.select("id", "text", F.col("to").alias("block"), F.lit(True).alias("copy")))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has the next document's beginning, in descending order of ids, in place of its last third.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    n = rows.count()
    words = lexicon(rows, F.col("text"), n)
    signed = with_fingerprint(_in_blocks(rows, n), "text", "own", words)
    order = Window.partitionBy("block").orderBy("copy", F.desc("id"), "text")
    after = lambda c: F.when(F.col("id").isNotNull(), F.lead(c).over(order))
    paired = signed.withColumns({"next_text": after("text"), "next": after("own"), "next_all": after("own_all")}).filter("not copy")
    chars = F.length("text")
    third = F.floor(chars / 3).cast("int")
    edited = paired.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), chars - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third)))
    both = _once(with_fingerprint(edited.drop("next_text"), "edited", "new", words))
    return both.select("id", chars.cast("bigint").alias("n_chars"), "edited", as_text("own").alias("fingerprint"), as_text("new").alias("edited_fingerprint"), likeness("own", "new").alias("near_edited"), likeness("own", "next").alias("near_next"))
