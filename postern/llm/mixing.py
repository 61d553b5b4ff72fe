"""Mixing sources to target weights by entropy balancing.

The mix takes document d at rate w_d.  Among all rates between 0 and `most` with which the words taken of
each source meet its target, it takes those closest to the base rate q = `share` by relative entropy:
minimise sum w_d log(w_d / q) - w_d + q.  The convex dual has one multiplier per source, and its solution
tilts each document exponentially by its size,

    w_d = min(most, q * exp(multiplier_s * size_d)).

A source whose target is below q times its size thus gives up its long documents first, and one whose
target is above takes them more often: that changes the fewest documents.  Newton's iterations run for all
sources at once: each is one distributed aggregate over the cells (source, size, number of documents),
which hold the same sums as the documents, for the gradient (words taken less target) and the Hessian.
A bracket around each multiplier guards the steps; a step that would leave it halves it instead.  The sums
are decimals, so they do not depend on the order in which tasks add them, and reruns agree to the last bit.

Rates become copies.  Every document is taken floor(w) times.  What the source then lacks is drawn among
its documents by sequential Poisson sampling: u / (w - floor(w)), with u from a hash of the row, orders
them, and the longest start of that order that fits is taken once more.  The end of the start is found by
histograms of that order, each refining the bucket in which the last one ended until it is small, so no
source is ever in one task.  The little that is left is filled by sizes: of the greatest size that still
fits as many documents as fit, and so on downwards.  Then nothing fits any more: a source lacks fewer words
than its smallest document that could be taken once more has.  Rows that are equal in all columns are told
apart by their number only: if some of them are taken once more, that many are.

Targets: sources in code point order, null last, weigh 3, 1, 2, repeating, and share `share` of all sizes;
a target stops at `most` times its source's size, the excess is shared anew by weight.  The order is a
distributed sort and the sharing a loop of aggregates, so the number of sources has no bound either.

Sizes are words [^\\x20\\x09-\\x0D]+ of the text, null texts have none.  Documents without words keep the
base rate, rounded down.  Null ids and null sources are values like others.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postern.llm.common import WORD, remove, row_hash, written, written_at

WEIGHTS = (3, 1, 2)
#: The words taken meet the target to this part of it before they are rounded.
TOLERANCE = 1e-9
#: An order has 62 bits; a histogram takes 10 of them, and an end is looked for in buckets of at most so many rows.
ORDER_BITS, STEP_BITS, SMALL_ROWS = 62, 10, 50_000
#: Rows that are made from one are made so many a task.
CHUNK = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- targets ---------------------------------------------------------------------------------------


def numbered(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources with sid, their place in code point order (null last, from 0), and weight."""
    ordered = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    placed = written(ordered, "mix-order")
    # As many rows as the sort had partitions.
    offsets = placed.groupBy("part").agg(F.count("*").alias("n"))
    offsets = offsets.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    sid = (F.col("before") + F.col("within")).cast("long")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    return placed.withColumn("within", within).join(offsets, "part").withColumn("sid", sid).withColumn("weight", weight).drop("part", "within", "before")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size and any others) with sid, weight and target.

    A source is full if its share by weight reaches its top.  Each round shares what the full ones leave by
    the weights of the others, which can only fill more of them, and ends when it fills none.
    """
    known = written(numbered(sources, weights), "mix-numbered")
    top = F.col("source_size") * F.lit(most)
    budget, weight = known.agg(F.sum("source_size") * F.lit(share), F.sum("weight")).first()
    level = (budget or 0.0) / (weight or 1.0)
    while budget:
        full = F.col("weight") * F.lit(level) >= top
        used, rest = known.agg(F.sum(F.when(full, top).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not rest or (budget - used) / rest <= level:
            break
        level = (budget - used) / rest
    if budget and not rest:
        return known.withColumn("target", top)
    return known.withColumn("target", F.least(F.col("weight") * F.lit(level), top))


# --- rates -----------------------------------------------------------------------------------------


def rate(size: Column, base: float, most: float) -> Column:
    """The rate of a document of a source with the columns full and multiplier."""
    return F.when(F.col("full"), F.lit(most)).otherwise(F.least(F.lit(most), F.lit(base) * F.exp(F.col("multiplier") * size)))


def balance(cells: DataFrame, sources: DataFrame, base: float = 1.5, most: float = 2.0, tolerance: float = TOLERANCE) -> DataFrame:
    """sources (sid, source_size, target, ...) with full and multiplier, the dual solution over cells (sid, size, n)."""
    spark = cells.sparkSession
    least = cells.where("size > 0").groupBy("sid").agg(F.min("size").alias("least"))
    q_size = F.lit(base) * F.col("source_size")
    full = F.col("target") >= F.lit(most) * F.col("source_size") * F.lit(1 - 1e-12)
    above, below = F.col("target") > q_size, F.col("target") < q_size
    settled = (F.col("source_size") == 0) | F.col("full")
    # The smallest size bounds the multiplier on the far side of 0.
    low = F.when(~F.col("settled") & below, F.log(F.col("target") / q_size) / F.col("least")).otherwise(0.0)
    high = F.when(~F.col("settled") & above, F.log(F.lit(most / base)) / F.col("least")).otherwise(0.0)
    start = sources.join(least, "sid", "left").withColumn("full", full & (F.col("source_size") > 0)).withColumn("settled", settled)
    start = start.select(*sources.columns, "full", "settled", F.lit(0.0).alias("multiplier"), low.alias("low"), high.alias("high"))
    state, path = written_at(start.withColumn("settled", F.col("settled") | (F.col("low") == F.col("high"))), "mix-dual")
    while state.where("NOT settled").limit(1).count():
        tilt = F.lit(base) * F.exp(F.col("multiplier") * F.col("size"))
        free = tilt < F.lit(most)
        exact = lambda c: c.cast("decimal(38,6)")
        words = F.col("n") * F.col("size").cast("double")
        open_ = state.where("NOT settled").select("sid", "multiplier")
        slopes = cells.where("size > 0").join(open_, "sid").groupBy("sid").agg(
            F.sum(exact(words * F.when(free, tilt).otherwise(F.lit(most)))).cast("double").alias("taken"),
            F.sum(exact(F.when(free, words * F.col("size") * tilt).otherwise(0.0))).cast("double").alias("slope"),
        )
        error = F.col("taken") - F.col("target")
        low = F.when(error <= 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(error >= 0, F.col("multiplier")).otherwise(F.col("high"))
        # Newton's step for the logarithm of the words taken, which is nearly linear in the multiplier.
        newton = F.when((F.col("slope") > 0) & (F.col("taken") > 0), F.col("multiplier") - F.log(F.col("taken") / F.col("target")) * F.col("taken") / F.nullif("slope", F.lit(0.0)))
        stepped = state.join(slopes, "sid", "left").withColumn("met", F.abs(error) <= F.lit(tolerance) * F.col("target"))
        stepped = stepped.withColumn("low2", F.coalesce(low, "low")).withColumn("high2", F.coalesce(high, "high")).withColumn("newton", newton)
        halved = (F.col("low2") + F.col("high2")) / 2
        ahead = F.when((F.col("newton") > F.col("low2")) & (F.col("newton") < F.col("high2")), F.col("newton")).otherwise(halved)
        # Between neighbouring numbers there is nothing left to try.
        closed = (halved == F.col("low2")) | (halved == F.col("high2"))
        done = F.col("settled") | F.col("met") | closed
        after = stepped.select(
            *sources.columns, "full", done.alias("settled"), F.when(done, F.col("multiplier")).otherwise(ahead).alias("multiplier"), F.col("low2").alias("low"), F.col("high2").alias("high")
        )
        last = path
        state, path = written_at(after, "mix-dual")
        remove(spark, last)
    return state.drop("settled", "low", "high")


# --- copies ----------------------------------------------------------------------------------------

_END = "struct<place:bigint,hash:bigint,size:bigint>"
_PART = "struct<place:bigint,hash:bigint,size:bigint,taken:bigint>"
_MAX = (1 << 63) - 1


def _measured(docs: DataFrame) -> list[Column]:
    """__size and __hash (63 bits, of all columns) of a document."""
    return [word_count(F.col("text").cast("string")).alias("__size"), row_hash(docs).bitwiseAND(F.lit(_MAX)).alias("__hash")]


def _whole(size: Column, base: float, most: float) -> Column:
    return F.floor(rate(size, base, most) + 1e-9).cast("long")


def _place(size: Column, hash_: Column, base: float, most: float) -> Column:
    """Place in the order of the draw, 62 bits: x / (1 + x) of x = u / (rate's broken part); null for a whole rate."""
    broken = rate(size, base, most) - _whole(size, base, most)
    u = (hash_ + F.lit(1)).cast("double") / F.lit(float(1 << 63))
    return F.when(broken > 1e-9, F.floor(u / (u + broken) * F.lit(float(1 << ORDER_BITS))).cast("long"))


def _ends(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """sid, cell, used, end and part for budgets (sid, cell, lack), over rows (sid, cell, size, place, hash).

    The longest start of the order (place, hash, size) of each sid and cell whose sizes are within lack:
    it holds all rows up to and with `end`, and part.taken of the equal rows that come next, if any fit.
    """
    shift, state = ORDER_BITS, budgets.select("sid", "cell", F.col("lack").cast("double").alias("lack"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("used"), F.lit(True).alias("open"))
    spark, path = rows.sparkSession, None

    def inside() -> DataFrame:
        asked = state.where("open").drop("open")
        return rows.join(asked, ["sid", "cell"]).where((F.col("place") >= F.col("low")) & (F.shiftright(F.col("place") - F.col("low"), shift) == 0))

    while shift > 0:
        finer = max(0, shift - STEP_BITS)
        sums = inside().groupBy("sid", "cell", F.shiftright(F.col("place") - F.col("low"), finer).alias("bucket")).agg(F.sum("size").alias("sizes"), F.count("*").alias("n"))
        upto = F.sum("sizes").over(Window.partitionBy("sid", "cell").orderBy("bucket"))
        sums = sums.withColumn("upto", upto).join(state.select("sid", "cell", (F.col("lack") - F.col("used")).alias("room")), ["sid", "cell"])
        found = sums.groupBy("sid", "cell").agg(
            F.min(F.when(F.col("upto") > F.col("room"), F.struct("bucket", (F.col("upto") - F.col("sizes")).alias("before"), "n"))).alias("edge"),
            F.max("upto").alias("all"),
        )
        fits = F.col("edge").isNull()
        joined = state.join(found, ["sid", "cell"], "left")
        after = joined.select(
            "sid", "cell", "lack",
            F.when(~F.col("open"), F.col("low")).when(fits, F.lit(_MAX)).otherwise(F.col("low") + F.shiftleft("edge.bucket", finer)).alias("low"),
            (F.col("used") + F.when(F.col("open"), F.coalesce("edge.before", "all", F.lit(0))).otherwise(0)).alias("used"),
            (F.col("open") & ~fits).alias("open"), F.coalesce("edge.n", F.lit(0)).alias("n"),
        )
        state, next_path = written_at(after, "mix-ends")
        if path:
            remove(spark, path)
        path, shift = next_path, finer
        if (state.agg(F.max("n")).first()[0] or 0) <= SMALL_ROWS:
            break
        state = state.drop("n")
    state = state.drop("n")
    # What is left of each order is few different rows: equal ones are counted before they are shuffled.
    kinds = inside().groupBy("sid", "cell", "place", "hash", "size").agg(F.count("*").alias("m"), F.first("lack").alias("lack"), F.first("used").alias("used"))
    upto = F.col("used") + F.sum(F.col("m") * F.col("size")).over(Window.partitionBy("sid", "cell").orderBy("place", "hash", "size"))
    kinds = kinds.withColumn("upto", upto).withColumn("room", F.col("lack") - (F.col("upto") - F.col("m") * F.col("size")))
    some = F.struct("place", "hash", "size", F.floor(F.col("room") / F.col("size")).cast("long").alias("taken"))
    last = kinds.groupBy("sid", "cell").agg(
        F.max(F.when(F.col("upto") <= F.col("lack"), F.struct("place", "hash", "size", "upto"))).alias("last"),
        F.min(F.when(F.col("upto") > F.col("lack"), some)).alias("next"),
    )
    # Without such a row the start ends before the bucket.
    before = F.struct((F.col("low") - F.when(F.col("low") == _MAX, 0).otherwise(1)).alias("place"), F.lit(_MAX).alias("hash"), F.lit(_MAX).alias("size"))
    end = F.when(F.col("last").isNotNull(), F.struct("last.place", "last.hash", "last.size")).otherwise(before).cast(_END)
    part = F.when(F.col("next.taken") > 0, F.col("next")).cast(_PART)
    used = F.coalesce("last.upto", "used") + F.coalesce(F.col("next.taken") * F.col("next.size"), F.lit(0))
    out = written(state.join(last, ["sid", "cell"], "left").select("sid", "cell", used.alias("used"), end.alias("end"), part.alias("part")), "mix-end")
    if path:
        remove(spark, path)
    return out


def _upto(end: Column, place: Column, hash_: Column, size: Column) -> Column:
    """Whether a row is in the start that ends with `end`; false where either is null."""
    later = (place > end["place"]) | ((place == end["place"]) & ((hash_ > end["hash"]) | ((hash_ == end["hash"]) & (size > end["size"]))))
    return F.coalesce(~later, F.lit(False))


def _fills(cells: DataFrame) -> DataFrame:
    """sid, size, n, takes: of cells (sid, size, n, lack) the greatest size that fits as often as it fits, and so on.

    A source has at most as many cells as different sizes below one document's.
    """

    def run(key, table):
        import pyarrow as pa

        size, n = (table.column(c).to_pylist() for c in ("size", "n"))
        left, out = table.column("lack")[0].as_py(), []
        for s, many in sorted(zip(size, n, strict=True), reverse=True):
            if takes := min(many, int(left // s)):
                left -= takes * s
                out.append((s, many, takes))
        columns = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.int64()), *columns], ["sid", "size", "n", "takes"])

    return cells.groupBy("sid").applyInArrow(run, "sid long, size long, n long, takes long")


def plan(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): doc_id, source, size and hash of every document, and of every source sid, source_size,
    target, full, multiplier, and `ends`: where the draw and the fillings of sizes end."""
    spark = docs.sparkSession
    rows = written(docs.select("doc_id", "source", *_measured(docs)).withColumnsRenamed({"__size": "size", "__hash": "hash"}), "mix-sizes")
    cells, cells_path = written_at(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-cells")
    known = targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, most, weights)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    cells, named_path = written_at(cells.join(known.select("sid", F.col("source").alias("__s")), same("source", "__s")).select("sid", "size", "n"), "mix-cells")
    remove(spark, cells_path)
    sources, sources_path = written_at(balance(cells, known, share, most), "mix-rates")
    rates = sources.select("sid", "full", "multiplier")
    whole, size, hash_ = _whole(F.col("size"), share, most), F.col("size"), F.col("hash")
    base_words = cells.join(rates, "sid").groupBy("sid").agg(F.sum(F.col("n") * size * whole).alias("words"))
    lacks = sources.join(base_words, "sid", "left").select("sid", F.lit(-1).cast("long").alias("cell"), F.greatest(F.lit(0.0), F.col("target") - F.coalesce("words", F.lit(0))).alias("lack"))
    lacks, lacks_path = written_at(lacks, "mix-lacks")

    by_source = sources.select(F.col("source").alias("__s"), "sid", "full", "multiplier")
    able = rows.where("size > 0").join(by_source, same("source", "__s")).where(whole + 1 <= F.lit(most))
    able = able.select("sid", F.lit(-1).cast("long").alias("cell"), "size", "hash", _place(size, hash_, share, most).alias("place"))
    drawn = _ends(able.where("place IS NOT NULL"), lacks)

    # Rows that the draw left and that still fit.  The equal rows at its end do not: it stopped because they were too many.
    left = lacks.join(drawn, ["sid", "cell"]).select("sid", (F.col("lack") - F.col("used")).alias("lack"), "end", "part")
    left = able.drop("cell").join(left, "sid").where((size <= F.col("lack")) & ~_upto(F.col("end"), F.col("place"), hash_, size))
    left = left.where(~F.coalesce((F.col("part.place") == F.col("place")) & (F.col("part.hash") == hash_), F.lit(False)))
    left = left.withColumn("cell", size).withColumn("place", F.shiftright("hash", 63 - ORDER_BITS))
    fills = written(_fills(left.groupBy("sid", "size").agg(F.count("*").alias("n"), F.first("lack").alias("lack"))), "mix-fills")
    budgets = fills.select("sid", F.col("size").alias("cell"), (F.col("takes") * size).alias("lack"))
    filled = _ends(left.join(fills.select("sid", F.col("size").alias("cell")), ["sid", "cell"], "left_semi").select("sid", "cell", "size", "place", "hash"), budgets)

    every = drawn.unionByName(filled).groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("cell", "end", "part"))).alias("ends"))
    out = written(sources.join(every, "sid"), "mix-sources")
    for path in (named_path, sources_path, lacks_path):
        remove(spark, path)
    return rows, out


def _placed(rows: DataFrame, sources: DataFrame, share: float, most: float) -> DataFrame:
    """rows (source, __size, __hash, ...) with their source's columns, n (copies) and part: the end's equal rows, or null.

    Of rows with a part, part.taken are to be taken once more than n.
    """
    size, hash_ = F.col("__size"), F.col("__hash")
    wide = rows.join(sources.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
    wide = wide.withColumn("__whole", _whole(size, share, most)).withColumn("__drawn", _place(size, hash_, share, most)).withColumn("__filled", F.shiftright("__hash", 63 - ORDER_BITS))
    mine = lambda e: F.when(e["cell"] < 0, F.col("__drawn")).when(e["cell"] == size, F.col("__filled"))
    able = (size > 0) & (F.col("__whole") + 1 <= F.lit(most))
    taken = able & F.exists("ends", lambda e: F.coalesce(_upto(e["end"], mine(e), hash_, size), F.lit(False)))
    at_end = F.filter("ends", lambda e: F.coalesce((e["part"]["place"] == mine(e)) & (e["part"]["hash"] == hash_) & (e["part"]["size"] == size), F.lit(False)))
    return wide.withColumn("n", F.col("__whole") + taken.cast("long")).withColumn("part", F.when(able & ~taken, F.get(at_end, F.lit(0))["part"]))


def _repeated(df: DataFrame, times: str) -> DataFrame:
    """df with each row `times` times; the copies of one row are made by many tasks."""
    # Most rows are asked for a few times, and stay where they are.
    few = df.where(F.col(times).between(1, CHUNK)).withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return few.drop("__k")


def _spread(df: DataFrame, times: str) -> DataFrame:
    """As _repeated, for a handful of rows that are asked for any number of times."""
    chunks = df.where(F.col(times) > 0).withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / F.lit(CHUNK)).cast("long"))))
    dealt = chunks.withColumn(times, F.least(F.lit(CHUNK).cast("long"), F.col(times) - F.col("__c") * CHUNK)).repartition("sid", "__hash", "__c")
    return _repeated(dealt, times).drop("__c")


def _at_ends(placed: DataFrame, *columns: str) -> DataFrame:
    """One row for each set of equal rows at an end: sid, __hash, n, part, m (their number) and the columns."""
    return placed.where("part IS NOT NULL").groupBy("sid", "__size", "__hash", "n", "part").agg(F.count("*").alias("m"), *(F.first(c).alias(c) for c in columns))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken, rate and copies of every row."""
    rows, sources = plan(docs, share, most, weights)
    placed = _placed(rows.withColumnsRenamed({"size": "__size", "hash": "__hash"}), sources, share, most)
    placed = placed.withColumn("rate", rate(F.col("__size"), share, most))
    shown = ["doc_id", "__size", "source_size", "target", "rate", "n"]
    ends = _at_ends(placed, "doc_id", "source_size", "target", "rate")
    more = _spread(ends.withColumn("t", F.col("part.taken")).withColumn("n", F.col("n") + 1), "t")
    same = _spread(ends.withColumn("t", F.col("m") - F.col("part.taken")), "t")
    out = placed.where("part IS NULL").select(shown).unionByName(more.select(shown)).unionByName(same.select(shown))
    return out.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("n") * F.col("__size")).cast("long").alias("taken"), "rate", F.col("n").cast("int").alias("copies"))


def mix_stage(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs with every row as often as the mix takes it."""
    _, sources = plan(docs, share, most, weights)
    # The row travels as one value, so its columns can have any names.
    placed = _placed(docs.select(F.struct("*").alias("row"), "source", *_measured(docs)), sources, share, most)
    ends = _at_ends(placed, "row").withColumn("t", F.col("m") * F.col("n") + F.col("part.taken"))
    out = _repeated(placed.where("part IS NULL").select("row", "n"), "n").select("row")
    return out.unionByName(_spread(ends, "t").select("row")).select("row.*")
