"""Lines whose template recurs across documents, in DataFrame operations alone.

A fixed-depth tree over lines: token count, then the leading tokens (those with a digit read
as a variable). Lines that share a leaf are generalised there: a token that too few lines of
the leaf have at that place is a variable field. A line's template is what stays. Only lines
of leaves that enough documents reach are looked at closer, each distinct line once.

A passage may be wrapped over several lines. Each line that another text has too starts and
ends the shortest run of such lines with enough words; the runs that two texts share cover
every longer passage that they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtables.scratch import materialise, released

#: Leading tokens that choose a leaf; documents that make a template recurring.
DEPTH, MIN_DOCS = 3, 10
#: A line this long recurs by chance in no two texts, so two will do.
LONG_WORDS, LONG_DOCS = 50, 2
#: Shortest line that can be a template, and the percentage of its tokens that must be fixed
#: words; variables don't count.
MIN_WORDS, FIXED = 3, 70

_VARIABLE = "<*>"


def _spaced(line: Column) -> Column:
    """The line's tokens with one space between."""
    odd = line.startswith(" ") | line.endswith(" ")
    for part in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | line.contains(part)
    return F.when(odd, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)


def _masked(spaced: Column) -> Column:
    """Tokens with a digit as variables."""
    return F.when(
        spaced.rlike("[0-9]"), F.regexp_replace(spaced, "[^ ]*[0-9][^ ]*", _VARIABLE)
    ).otherwise(spaced)


def _n_words(line: Column) -> Column:
    n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return F.when(line == "", 0).otherwise(n)


def _read(lines: DataFrame, fixed: int) -> DataFrame:
    """``line``, the masked form of ``raw``, in its place; ``alone`` where a line is taken as it
    stands, since its masked tokens leave too few words fixed: rows of numbers that differ are
    different lines."""
    lines = lines.withColumn("line", _masked(F.col("raw")))
    masked = F.when(
        F.col("line").contains(_VARIABLE), F.regexp_count("line", F.lit(r"(?<![^ ])<\*>(?![^ ])"))
    ).otherwise(0)
    lines = lines.withColumn("alone", 100 * (F.col("n") - masked) < fixed * F.col("n"))
    return lines.withColumn(
        "line", F.when(F.col("alone"), F.col("raw")).otherwise(F.col("line"))
    ).drop("raw")


def _lines(documents: DataFrame, min_words: int, depth: int, fixed: int) -> DataFrame:
    """``line`` (masked), its token count, number among such lines (``seq``), leaf and key, for
    lines of enough tokens. A line that is ``alone`` has a leaf of its own.
    """

    def both(spaced: Column, i: Column) -> Column:
        return F.struct(i.alias("line_no"), spaced.alias("raw"), _n_words(spaced).alias("n"))

    every = F.transform(F.transform(F.split("text", "\n"), _spaced), both)
    lines = documents.select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        F.posexplode(F.filter(every, lambda x: x["n"] >= min_words)).alias("seq", "both"),
    ).select("doc_id", "text_key", "seq", "both.*")
    lines = _read(lines, fixed)
    first = F.when(F.col("alone"), F.col("line")).otherwise(F.substring_index("line", " ", depth))
    return lines.withColumns(
        {
            "leaf": F.xxhash64("n", "alone", first),
            "line_key": F.struct(F.xxhash64("line").alias("a"), F.hash("line", "alone").alias("b")),
        }
    )


def _runs(
    places: DataFrame, distinct: DataFrame, long_words: int, long_docs: int, min_words: int
) -> DataFrame:
    """Places of lines in recurring runs of two or more lines with ``long_words`` words.

    Lines too short to be a template neither count nor interrupt.
    """
    shared = distinct.filter(F.col("weight") >= long_docs).select("line_key")
    line = F.struct("seq", "line_no", "n", "line_key")
    own = Window.partitionBy("doc_id", "text_key").orderBy("seq")
    most = -(-long_words // min_words) - 1
    around = (
        places.join(shared, "line_key", "left_semi")
        .repartition("doc_id", "text_key")
        .dropDuplicates(["doc_id", "text_key", "seq"])
        .withColumn("at", line)
        .select(
            "doc_id",
            "text_key",
            F.collect_list("at").over(own.rowsBetween(0, most)).alias("ahead"),
            F.reverse(F.collect_list("at").over(own.rowsBetween(-most, 0))).alias("behind"),
        )
    )

    def shortest(lines: Column, step: int) -> Column:
        """The first lines that are consecutive and have enough words; null if there are none."""
        start = F.struct(
            F.lit(0).alias("words"), F.lit(0).alias("size"), F.get(lines, 0)["seq"].alias("seq")
        )

        def more(a: Column, x: Column) -> Column:
            grown = F.struct(
                (a["words"] + x["n"]).alias("words"),
                (a["size"] + 1).alias("size"),
                (a["seq"] + step).alias("seq"),
            )
            return F.when((a["words"] < long_words) & (x["seq"] == a["seq"]), grown).otherwise(a)

        end = F.aggregate(lines, start, more)
        return F.element_at(
            F.transform(
                F.array(end),
                lambda e: F.when(
                    (e["words"] >= long_words) & (e["size"] > 1),
                    F.slice(lines, F.lit(1), e["size"]),
                ),
            ),
            1,
        )

    runs = around.select(
        "doc_id",
        "text_key",
        F.explode(F.array(shortest(F.col("ahead"), 1), shortest(F.col("behind"), -1))).alias("run"),
    ).filter(F.col("run").isNotNull())
    keys = F.transform(F.sort_array("run"), lambda x: x["line_key"])
    runs = runs.select(
        "doc_id",
        "text_key",
        F.struct(F.xxhash64(keys).alias("a"), F.hash(keys).alias("b")).alias("run_key"),
        F.transform("run", lambda x: x["line_no"]).alias("line_nos"),
    )
    runs = materialise(runs, "runs")
    counted = (
        runs.groupBy("run_key", "text_key")
        .agg(
            F.min(
                F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
            ).alias("first")
        )
        .groupBy("run_key").agg(F.count("*").alias("docs"), F.min("first").alias("first"))
        .filter(F.col("docs") >= long_docs)
    )
    return runs.join(counted, "run_key").select(
        "doc_id", "text_key", F.explode("line_nos").alias("line_no"), "docs", "first"
    )


def _reached(distinct: DataFrame, held: DataFrame, needed: Column) -> DataFrame:
    """``leaf`` of the leaves that enough texts reach.

    Where one line has enough texts its leaf has them too; only the texts of the other leaves,
    which then have no common line, are counted.
    """
    sized = distinct.groupBy("leaf", "n").agg(
        F.sum("weight").alias("rows"), F.max("weight").alias("most")
    )
    sized = sized.filter(F.col("rows") >= needed).select("leaf", (F.col("most") >= needed).alias("sure"))
    sized = materialise(sized, "leaves")
    counted = (
        held.select("leaf", "n", "text_key")
        .join(sized.filter("not sure"), "leaf", "left_semi")
        .distinct()
        .groupBy("leaf", "n").agg(F.count("*").alias("texts"))
        .filter(F.col("texts") >= needed)
    )
    every = sized.filter("sure").select("leaf").unionByName(counted.select("leaf"))
    return materialise(every.distinct(), "reached")


def _with_words(distinct: DataFrame, documents: DataFrame, fixed: int) -> DataFrame:
    """``words`` of distinct lines, a digest for each token and place that is no variable; each
    line is read from one of the texts that have it."""
    at = F.struct("leaf", "n", "line_key", "weight", "line_no").alias("at")
    wanted = distinct.groupBy(
        F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")
    ).agg(F.collect_list(at).alias("every"))
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    same = docs.doc_id.eqNullSafe(wanted.of_id) & (docs.text_key == wanted.of_key)
    parts = F.split("text", "\n")
    raw = F.transform("every", lambda x: _spaced(F.get(F.col("parts"), x["line_no"])))
    lines = (
        docs.join(wanted, same)
        .select("every", parts.alias("parts"))
        .select(F.inline(F.arrays_zip("every", raw.alias("raw"))))
        .select("every.*", "raw")
    )
    word = F.transform(
        F.split("line", " "), lambda t, i: F.when(t != _VARIABLE, F.xxhash64(i, t))
    )
    # a row that repeats gives its lines again
    return (
        _read(lines, fixed)
        .select("leaf", "n", "line_key", "weight", F.array_compact(word).alias("words"))
        .dropDuplicates(["line_key"])
    )


def _variable(reached: DataFrame, needed: Column, most: int) -> DataFrame:
    """Of each line those ``words`` that too few lines of its leaf have at their place.

    A line that enough texts have is its own template, and so a leaf of such lines alone needs
    no look at its words. As every line weighs one or more, ``most`` lines of a word tell that
    it has enough, so a word of very many lines costs a few rows of each task.
    """
    few = reached.filter(F.col("weight") < needed).select("leaf").distinct()
    words = reached.join(few, "leaf", "left_semi").select(
        "leaf", "n", "line_key", "weight", F.explode("words").alias("word")
    )
    same = Window.partitionBy("leaf", "word")
    rare = (
        words.withColumn("row", F.row_number().over(same.orderBy("line_key")))
        .filter(F.col("row") <= most)
        .withColumn("support", F.sum("weight").over(same))
        .filter(F.col("support") < needed)
    )
    return rare.groupBy("line_key").agg(F.collect_list("word").alias("variable"))


def recurring_lines(
    documents: DataFrame,
    depth: int = DEPTH,
    min_docs: int = MIN_DOCS,
    long_words: int = LONG_WORDS,
    long_docs: int = LONG_DOCS,
    min_words: int = MIN_WORDS,
    fixed: int = FIXED,
) -> DataFrame:
    """Places of recurring lines, ``docs`` (texts with the template) and the first document
    that has it; a line of several recurring runs comes once for each.

    Equal whole texts count once, as copies of a document say nothing about its lines.
    The first document is the one with the smallest doc_id, null last.
    """
    needed = F.when(F.col("n") >= long_words, long_docs).otherwise(min_docs)
    lines = _lines(documents, min_words, depth, fixed).drop("line", "alone")
    places = materialise(lines, "lines")
    held = places.groupBy("line_key", "text_key").agg(
        F.first("leaf").alias("leaf"),
        F.first("n").alias("n"),
        F.min("doc_id").alias("doc_id"),
        F.min("line_no").alias("line_no"),
    )
    held = materialise(held, "held")
    distinct = held.groupBy("line_key").agg(
        F.first("leaf").alias("leaf"),
        F.first("n").alias("n"),
        F.count("*").alias("weight"),
        F.min("text_key").alias("text_key"),
        F.min_by("doc_id", "text_key").alias("doc_id"),
        F.min_by("line_no", "text_key").alias("line_no"),
    )
    distinct = materialise(distinct, "distinct_lines")
    leaves = _reached(distinct, held, needed)
    reached = _with_words(distinct.join(leaves, "leaf", "left_semi"), documents, fixed)
    reached = materialise(reached, "reached_lines")
    variable = _variable(reached, needed, max(min_docs, long_docs))
    words = F.coalesce(F.array_except("words", "variable"), F.col("words"))
    words = F.when(100 * F.size(words) >= fixed * F.col("n"), words).otherwise(F.col("words"))
    templates = reached.join(variable, "line_key", "left").select(
        "line_key", F.struct("leaf", F.xxhash64(words).alias("key")).alias("template")
    )
    held = held.withColumn("first", F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    reach = held.join(templates, "line_key").groupBy("template", "n", "text_key")
    counted = reach.agg(F.min("first").alias("first")).groupBy("template", "n").agg(
        F.count("*").alias("docs"), F.min("first").alias("first")
    )
    recurring = counted.filter(F.col("docs") >= needed).drop("n")
    found = templates.join(recurring, "template").join(places, "line_key")
    found = found.select("doc_id", "text_key", "line_no", "docs", "first")
    return found.unionByName(_runs(places, distinct, long_words, long_docs, min_words)).select(
        "doc_id",
        "text_key",
        "line_no",
        "docs",
        F.col("first.doc_id").alias("first_id"),
        F.col("first.text_key").alias("first_key"),
    )


def drop_recurring(documents: DataFrame, keep_first: bool = True, **options) -> DataFrame:
    """``documents`` as a struct ``document``, its new ``text``, ``n_lines`` and ``n_dropped``.

    Lines of recurring templates go, but for the document that has the template first, so
    that what they say stays in the corpus once (``keep_first=False`` drops them there too).
    Lines shorter than ``min_words``, blank ones too, are never dropped. A null text stays
    null with no lines; an empty one is one line. Rows that repeat are treated alike.
    """
    with released(documents.sparkSession) as kept:
        found = recurring_lines(documents.select("doc_id", "text"), **options)
        if keep_first:
            first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (
                F.col("text_key") == F.col("first_key")
            )
            found = found.filter(~first)
        drops = found.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("gone"))
        drops = kept(drops.toDF("gone_id", "gone_key", "gone"), "drops")
    docs = documents.select(
        F.struct("*").alias("document"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key")
    )
    same = docs.id.eqNullSafe(drops.gone_id) & (docs.key == drops.gone_key)
    lines = F.split("document.text", "\n")
    total = F.coalesce(F.size(lines), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.element_at(
        F.transform(
            F.array(lines), lambda x: F.array_join(F.transform(kept, lambda i: F.get(x, i)), "\n")
        ),
        1,
    )
    return docs.join(drops, same, "left").select(
        "document",
        F.when(F.col("gone").isNull(), F.col("document.text")).otherwise(text).alias("text"),
        F.when(F.col("document.text").isNull(), 0).otherwise(total).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def without_recurring(documents: DataFrame, **options) -> DataFrame:
    """``documents``, all their columns, without recurring lines.

    Where lines went, ``n_chars`` (if there is one) is counted anew, and a document of which
    no word is left goes: all it said stays elsewhere.
    """
    found = drop_recurring(documents, **options)
    word = F.translate(F.col("text"), " \t\n\x0b\x0c\r", "") != ""
    found = found.filter((F.col("n_dropped") == 0) | word)
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}

    def column(name: str) -> Column:
        old = F.col("document").getField(name)
        if name not in changed:
            return old.alias(name)
        kind = documents.schema[name].dataType
        return F.when(F.col("n_dropped") > 0, changed[name].cast(kind)).otherwise(old).alias(name)

    return found.select(*(column(name) for name in documents.columns))
