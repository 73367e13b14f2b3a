"""Operator 9 [native]: delete repeated runs of lines, found with a suffix array.

A line is deleted when it lies in a run of consecutive lines of its document, at least
``min_words`` words long, whose very same sequence of lines begins earlier in the corpus
(ascending document id, then line number).  The first copy always stays.

Method (DataFrame functions only):

* lines get ids; only lines that occur twice or more can be part of a repeated run, and
  only islands of such lines with ``min_words`` words are worth sorting;
* prefix doubling ranks the suffixes by their first 1, 2, 4, ... lines: pairs of ranks
  (of a place and of the place 2**k further on) are counted, pairs that occur once leave,
  and the others get order-preserving ranks by a range sort.  A rank table is the (inverse)
  suffix array of the repeated suffixes, so a round costs what is still repeated;
* all suffixes whose longest common prefix reaches l lines form one interval of the suffix
  array.  It is named by the ranks of its two overlapping 2**k-line windows, and its
  earliest member is one minimum per interval.  Intervals are asked for at the depths that
  decide: from each line the shortest run of ``min_words`` words, and each longer run in
  which all lines but the first fall short of it.  The union of these runs that have an
  earlier copy is the union of all maximal repeated runs.

Counts and minima are pre-aggregated before they are shuffled, so a line that fills a
third of the corpus is one row per task there; window functions only span one document.

Defined results: null text stays null with no lines; an empty text is one empty line;
rows that repeat id and text are one document and share the result; a null id sorts
before all others; documents of one id with different texts follow each other by the hash
of the text; other columns are ignored; runs may overlap their own copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalframe.llm.shared import shared_table

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
DOC = ["d", "h"]


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, "doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63)).alias("d"),
                       F.xxhash64("text").alias("h"))


def _ranks(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Order-preserving numbers of the distinct ``keys`` rows."""
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shared_table(groups.select(*keys).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                        .withColumn("rank", F.monotonically_increasing_id()), "ranks")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, h, lo, hi): the merged line ranges [lo, hi) to delete in each document."""
    lines = (_keyed(docs).where("text is not null").select(*DOC, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
             .select(*DOC, "pos", F.xxhash64("line").alias("x"), F.xxhash64("line", F.lit("second")).alias("y"),
                     F.regexp_count("line", F.lit(WORD)).cast("long").alias("words")))
    lines = shared_table(lines, "lines")
    twice = _ranks(lines.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1"), ["x", "y"])
    of_doc = Window.partitionBy(*DOC).orderBy("pos")
    rows = (lines.join(twice, ["x", "y"]).select(*DOC, "pos", "words", "rank").dropDuplicates([*DOC, "pos"])
            .withColumn("island", F.col("pos") - F.row_number().over(of_doc)))
    island = Window.partitionBy(*DOC, "island")
    rows = (rows.withColumn("before", F.sum("words").over(island.orderBy("pos")) - F.col("words"))
            .withColumn("total", F.sum("words").over(island)).withColumn("stop", F.max("pos").over(island) + 1)
            .where(F.col("total") >= min_words))
    later = island.orderBy(F.col("before").desc()).rangeBetween(Window.unboundedPreceding, -min_words)
    rows = rows.withColumn("end", F.coalesce(F.min("pos").over(later), F.when(F.col("total") - F.col("before") >= min_words,
                                                                                F.col("stop"))))
    rows = shared_table(rows.withColumn("next_end", F.coalesce(F.lead("end").over(island.orderBy("pos")) - 1, "stop")),
                        "islands")
    runs = (rows.where("end is not null")
            .select(*DOC, "pos", F.explode(F.expr("sequence(end, greatest(end, next_end))")).alias("stop"))
            .withColumn("k", F.floor(F.log2(F.col("stop") - F.col("pos") + F.lit(0.5))).cast("int")))
    longest = runs.agg(F.max("k")).first()[0]
    if longest is None:
        return rows.select(*DOC, F.col("pos").alias("lo"), F.col("pos").alias("hi")).where("false")

    level = rows.select(*DOC, "pos", "rank")
    table = level.withColumn("k", F.lit(0))
    for k in range(longest):  # prefix doubling
        ahead = Window.partitionBy(*DOC).orderBy("pos").rangeBetween(1 << k, 1 << k)
        pairs = level.withColumn("then", F.max("rank").over(ahead)).where("then is not null")
        pairs = pairs.withColumnRenamed("rank", "here")
        names = _ranks(pairs.groupBy("here", "then").agg(F.count("*").alias("n")).where("n > 1"), ["here", "then"])
        level = shared_table(pairs.join(names, ["here", "then"]).select(*DOC, "pos", "rank"), "level")
        table = table.unionByName(level.withColumn("k", F.lit(k + 1)))

    place = F.col("stop") - F.expr("shiftleft(1, k)")
    runs = (runs.join(table.withColumnRenamed("rank", "a"), [*DOC, "pos", "k"]).withColumn("at", place)
            .join(table.select(*DOC, "k", F.col("pos").alias("at"), F.col("rank").alias("b")), [*DOC, "at", "k"])
            .select(*DOC, "pos", "stop", (F.col("stop") - F.col("pos")).alias("depth"), "a", "b"))
    runs = shared_table(runs, "runs")
    me = F.struct(*DOC, "pos")
    first = runs.groupBy("depth", "a", "b").agg(F.min(me).alias("first"), F.max(me).alias("last")).where("first < last")
    later = (runs.join(first.select("depth", "a", "b", "first"), ["depth", "a", "b"]).where(F.col("first") < me)
             .groupBy(*DOC, "pos").agg(F.max("stop").alias("stop")))
    seen = Window.partitionBy(*DOC).orderBy("pos")
    return (later.withColumn("reach", F.max("stop").over(seen.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("group", F.sum((F.col("reach").isNull() | (F.col("pos") > F.col("reach"))).cast("int")).over(seen))
            .groupBy(*DOC, "group").agg(F.min("pos").alias("lo"), F.max("stop").alias("hi")).drop("group"))


def _cut(rows: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """``rows`` (with d, h and text) and their new text and line counts."""
    cuts = (repeated_runs(docs, min_words).groupBy(*DOC)
            .agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("cuts")))
    kept = F.expr("transform(sequence(0, size(cuts)), i -> slice(lines, if(i = 0, 0, cuts[i - 1].hi) + 1, "
                  "if(i = size(cuts), size(lines), cuts[i].lo) - if(i = 0, 0, cuts[i - 1].hi)))")
    return (rows.join(cuts, DOC, "left").withColumn("lines", F.split("text", "\n", -1))
            .withColumn("new", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(kept), "\n")))
            .withColumn("n_lines", F.when(F.col("text").isNotNull(), F.size("lines")).otherwise(0).cast("long"))
            .withColumn("n_removed", F.coalesce(F.expr("aggregate(cuts, 0L, (n, c) -> n + c.hi - c.lo)"), F.lit(0)).cast("long")))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of every row, without the later copies."""
    return _cut(_keyed(docs), docs, min_words).select("doc_id", F.col("new").alias("text"), "n_lines", "n_removed")


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs``, all columns, with the shortened texts; rows of which no line is left go.
    A column ``n_chars`` is brought up to date where the text changed."""
    rows = _keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text"), "row")
    cut = _cut(rows, docs, min_words).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    out = []
    for c in docs.columns:
        own = F.col("row")[c]
        if c == "text":
            own = F.col("new")
        elif c == "n_chars":
            own = F.when(F.col("n_removed") > 0, F.char_length("new")).otherwise(own).cast(docs.schema[c].dataType)
        out.append(own.alias(c))
    return cut.select(*out)
