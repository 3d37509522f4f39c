"""Line dedup by deletion neighbourhoods, with DataFrame functions only.

A line is its words; lines shorter than `least_words` stay. A line is removed if an earlier
line (by document number, then place) has the same words or, where it has at least `least_near`
words, differs in one word: replaced, inserted or left out.

Every line with a word is counted, and near copies are looked for from three words on (of shorter lines,
any two would be near).

Equal lines are counted first, by 128 bits of hash. Of the distinct ones, only those can be within
one edit of another which share their first or their last p words with it (p the largest power of
two up to half their words, or that of one word less): an edit can't touch both ends. For these
all variants with one word left out are written as hashed keys, the line itself as well:

* lines with one variant in common, left out at one place, differ by a replaced word;
* a line that is a variant of another one differs by an inserted word.

So the earliest line of each key (and place) is a neighbour of all others with it; no pairs
within a key are written. Each neighbour found is compared by its words before it counts.
Minima are summed before shuffling, and joins are by keys that can be split, so a line that makes up a third
of the corpus is no hot group. Hashes of variants are running exclusive-or sums over the words of a
line, so work is linear in the length of a line.

Cases: a null or empty text has no line to remove; rows with one document number count as one
document, rows without a number as the last one; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

LAST = (1 << 63) - 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def plain(line: Column) -> Column:
    """The words of a line with one space between them; most lines are so already."""
    odd = F.contains(line, F.lit("  "))
    for mark in "\t\x0b\f\r":
        odd = odd | F.contains(line, F.lit(mark))
    return F.trim(F.when(odd, F.regexp_replace(line, "[ \\t\\x0B\\f\\r]+", " ")).otherwise(line))


def spaces_in(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def half(n: Column) -> Column:
    """Largest power of two up to n / 2; n is at least 2."""
    return F.pow(F.lit(2), F.floor(F.log2(n / F.lit(2)))).cast("int")


def end_keys(words: Column, n: Column) -> Column:
    """Hashes of the first and last words, for lines of as many words and of one less."""
    p, q = half(n), half(n - 1)
    sides = [(0, F.slice(words, 1, p), p), (1, F.slice(words, n - p + 1, p), p)]
    less = [(0, F.slice(words, 1, q), q), (1, F.slice(words, n - q + 1, q), q)]
    both = F.array(*[F.xxhash64(F.lit(side), k, part) for side, part, k in sides])
    return F.when(p == q, both).otherwise(F.array(*[F.xxhash64(F.lit(side), k, part) for side, part, k in sides + less]))


def numbered_lines(docs: DataFrame, least_words: int, id_col: str, text_col: str) -> DataFrame:
    """(d, line, plain, n, h1, h2) of all lines of at least `least_words` words."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("d"), F.posexplode(lines_of(F.col(text_col))).alias("line", "value"))
    rows = rows.select("d", "line", plain(F.col("value")).alias("plain")).where(F.col("plain") != "")
    rows = rows.withColumn("n", spaces_in(F.col("plain")) + 1)
    if least_words > 1:
        rows = rows.where(F.col("n") >= least_words)
    return rows.withColumns({"h1": F.xxhash64("plain"), "h2": F.xxhash64(F.lit(1), "plain")})


def variants(lines: DataFrame) -> DataFrame:
    """(v, pos, id) of every line with each of its words left out, and of the line itself with pos -1."""
    words = lines.repartition("id").select("id", F.posexplode("words").alias("pos", "word"))
    here, ahead = F.xxhash64("word", "pos"), F.xxhash64("word", F.col("pos") - 1)
    up = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = words.select("id", "pos", here.alias("here"), ahead.alias("ahead")).select(
        "id", "pos", "here", F.bit_xor("here").over(up).alias("before"), F.bit_xor("ahead").over(up).alias("passed"), F.lead("pos").over(Window.partitionBy("id").orderBy("pos")).isNull().alias("last")
    )
    whole = sums.where("last").select("id", F.col("before").alias("v"), F.col("passed").alias("total"))
    left_out = sums.join(whole.select("id", "total"), "id").select(
        (F.col("before").bitwiseXOR(F.col("here"))).bitwiseXOR(F.col("total")).bitwiseXOR(F.col("passed")).alias("v"), "pos", "id"
    )
    return left_out.union(whole.select("v", F.lit(-1).alias("pos"), "id"))


def near_lines(distinct: DataFrame, docs: DataFrame, least_near: int, id_col: str, text_col: str) -> DataFrame:
    """(h1) of distinct lines with an earlier line one word away."""
    long = distinct.where(F.col("n") >= least_near)
    ends = long.select(F.explode("ends").alias("end"))
    shared = ends.groupBy("end").count().where("count > 1").select("end")
    likely = long.select("d", "line", "h1", F.explode("ends").alias("end")).join(shared, "end").select("d", "line", "h1").distinct()
    places = likely.groupBy("d").agg(F.collect_list("line").alias("places"))
    # words of the first occurrence; where rows share a number, the hash tells which line is meant
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("d"), F.col(text_col).alias("text")).join(places, "d")
    rows = rows.select("d", F.col("places"), lines_of(F.col("text")).alias("all")).select("d", "all", F.explode("places").alias("line"))
    rows = rows.select("d", "line", plain(F.get("all", F.col("line"))).alias("plain")).withColumn("h1", F.xxhash64("plain"))
    held = rows.join(likely, ["d", "line", "h1"]).groupBy("h1").agg(F.min(F.struct("d", "line")).alias("o"), F.min("plain").alias("plain"))
    held = cut_lineage(held.select(F.col("h1").alias("id"), "o", F.split("plain", " ", -1).alias("words")), "near-lines")

    keys = variants(held)
    several = keys.groupBy("v").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("v")
    keys = cut_lineage(keys.join(several, "v").join(held.select("id", "o"), "id"), "near-keys")
    first = keys.groupBy("v", "pos").agg(F.min(F.struct("o", "id", "pos")).alias("first"))
    by_line = first.groupBy("v").agg(
        F.min(F.when(F.col("pos") < 0, F.col("first"))).alias("line_first"), F.min(F.when(F.col("pos") >= 0, F.col("first"))).alias("variant_first")
    )
    replaced = keys.where("pos >= 0").join(first, ["v", "pos"])
    inserted = keys.join(by_line, "v").withColumn("first", F.when(F.col("pos") < 0, F.col("variant_first")).otherwise(F.col("line_first")))
    columns = ["id", "pos", F.col("first.id").alias("other"), F.col("first.pos").alias("other_pos")]
    pairs = replaced.where("first.o < o").select(*columns).union(inserted.where("first.o < o").select(*columns)).distinct()

    def without(words: str, pos: str) -> Column:
        at = F.col(pos)
        return F.when(at < 0, F.col(words)).otherwise(F.concat(F.slice(words, 1, F.greatest(at, F.lit(0))), F.slice(words, F.greatest(at, F.lit(0)) + 2, F.size(words))))

    pairs = pairs.join(held.select("id", F.col("words").alias("a")), "id").join(held.select(F.col("id").alias("other"), F.col("words").alias("b")), "other")
    return pairs.where(without("a", "pos") == without("b", "other_pos")).select(F.col("id").alias("h1")).distinct()


def removed_lines(docs: DataFrame, least_words: int = 1, least_near: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, lines) of documents with removed lines; `d` is the document number, the largest long for none."""
    lines = numbered_lines(docs, least_words, id_col, text_col)
    n = F.col("n")
    ends = F.when(n >= least_near, end_keys(F.split("plain", " ", -1), n))
    grouped = lines.select("h1", "h2", "n", F.struct("d", "line").alias("o"), ends.alias("ends")).groupBy("h1", "h2").agg(
        F.min("o").alias("o"), F.count("*").alias("times"), F.first("n").alias("n"), F.first("ends").alias("ends")
    )
    distinct = cut_lineage(grouped.select("h1", "h2", "o.d", "o.line", "times", "n", "ends"), "distinct-lines")
    near = near_lines(distinct, docs, least_near, id_col, text_col).withColumn("near", F.lit(True))
    hit = distinct.join(near, "h1", "left").where("times > 1 or near").select("h1", "h2", F.struct("d", "line").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("d", "line", "h1", "h2").join(hit, ["h1", "h2"]).where(F.col("near") | (F.struct("d", "line") > F.col("first")))
    return gone.groupBy("d").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def line_report(docs: DataFrame, least_words: int = 1, least_near: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of every row; `removed` holds line places from 0, ascending."""
    counts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.size(lines_of(F.col(text_col))).alias("n_lines"))
    gone = removed_lines(docs, least_words, least_near, id_col, text_col)
    out = counts.join(gone, F.coalesce("doc_id", F.lit(LAST)) == F.col("d"), "left")
    removed = F.coalesce(F.filter("lines", lambda i: i < F.col("n_lines")), F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"))


def drop_lines(docs: DataFrame, least_words: int = 1, least_near: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the removed lines; documents of which no line is left go, all columns stay."""
    gone = removed_lines(docs, least_words, least_near, id_col, text_col)
    name = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    joined = docs.select(name, F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("d")).join(gone, "d", "left")
    lines = lines_of(F.col(f"row.`{text_col}`"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lines"))
    out = joined.select("row", F.col("lines").isNotNull().alias("cut"), lines.alias("all"), kept.alias("kept"))
    text = F.when(F.col("cut"), F.concat_ws("\n", F.transform("kept", lambda i: F.get("all", i)))).otherwise(F.col(f"row.`{text_col}`"))
    out = out.where(~F.col("cut") | (F.size("kept") > 0))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


# Distinct lines with their first place, the variants of the longer ones, and removal by an earlier neighbour.
REPORT_SQL = """
WITH raw AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS al FROM documents
), lines AS (
  SELECT doc_id, unnest(range(len(al))) AS line, unnest(al) AS value FROM raw
), w AS (
  SELECT doc_id, line, list_filter(string_split_regex(value, '[ \\t\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM lines
), l AS (
  SELECT doc_id, line, words FROM w WHERE len(words) >= 1
), d AS (
  SELECT words, len(words) AS n, min((doc_id, line)) AS o, row_number() OVER () AS id FROM l GROUP BY words
), v AS (
  SELECT id, o, n, pos, words[1:pos] || words[pos + 2:] AS left_out
  FROM (SELECT *, unnest(range(n)) AS pos FROM d WHERE n >= 3)
), sub AS (SELECT left_out, pos, min(o) AS o FROM v GROUP BY ALL
), del AS (SELECT left_out, min(o) AS o FROM v WHERE n >= 4 GROUP BY ALL
), near AS (
  SELECT v.id FROM v JOIN sub USING (left_out, pos) WHERE sub.o < v.o
  UNION SELECT v.id FROM v JOIN d ON v.left_out = d.words WHERE v.n >= 4 AND d.o < v.o
  UNION SELECT d.id FROM d JOIN del ON d.words = del.left_out WHERE d.n >= 3 AND del.o < d.o
), gone AS (
  SELECT l.doc_id, list(l.line ORDER BY l.line) AS removed FROM l JOIN d USING (words)
  WHERE (l.doc_id, l.line) > d.o OR d.id IN (SELECT id FROM near) GROUP BY l.doc_id
)
SELECT doc_id, len(al)::INTEGER AS n_lines, coalesce(len(removed), 0)::INTEGER AS n_removed,
       coalesce(removed, [])::INTEGER[] AS removed
FROM raw LEFT JOIN gone USING (doc_id)
"""
