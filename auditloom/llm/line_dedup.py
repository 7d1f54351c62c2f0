"""Operator 2: remove runs of lines that stand elsewhere in the corpus already.

Lines are hashed; a rolling hash over two neighbouring line hashes, read forwards and backwards, chooses where chunks
begin. Both look only at lines on their own side of the boundary, so a passage is cut alike wherever it stands. A
line of LONG_WORDS words or more (several lines, were it wrapped) is a chunk of its own.

Chunks of two or more lines that aren't empty, and such long lines, are compared over the whole corpus: first by hash,
counted with partial sums, then byte by byte. Of equal chunks that with the smallest (doc_id, position) stays, the
others go. Bodies of chunks travel once, to the repeated hashes only; a hot chunk is split by Spark's join.

Null texts stay null and have no lines; an empty text is one empty line. Rows with one doc_id and equal texts keep or
lose the same chunks. Rows with a null doc_id come first in the order, so they lose nothing.
Native: built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, written

DIVISOR = 5
FACTOR = 7
LONG_WORDS = 50


def _with_chunks(df: DataFrame, text: str) -> DataFrame:
    """Adds __chunks: (pos, body, lines, checked) of each chunk."""
    is_long = lambda line: F.length(line) - F.length(F.replace(line, F.lit(" "))) >= LONG_WORDS - 1
    lines = df.withColumn("__lines", F.split(F.col(text), "\n", -1))
    hashed = lines.withColumn("__hashes", F.transform("__lines", lambda x: F.struct(F.conv(F.substring(F.md5(x.cast("binary")), 1, 6), 16, 10).cast("int").alias("h"), is_long(x).alias("long"))))
    at = lambda i: F.coalesce(F.get("__hashes", i)["h"], F.lit(0))
    cut = lambda a, b: (FACTOR * a + b) % DIVISOR == 0
    begins = lambda i: (
        (i == 0) | F.get("__hashes", i)["long"] | F.get("__hashes", i - 1)["long"] | cut(at(i), at(i + 1)) | cut(at(i - 1), at(i - 2))
    )
    starts = hashed.withColumn("__starts", F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), begins))

    def chunk(start, k):
        n = F.coalesce(F.get("__starts", k + 1), F.size("__lines")) - start
        own = F.slice("__lines", start + 1, n)
        checked = (F.size(F.filter(own, lambda x: x != "")) >= 2) | F.get("__hashes", start)["long"]
        return F.struct(k.alias("pos"), F.array_join(own, "\n").alias("body"), n.alias("lines"), checked.alias("checked"))

    chunks = F.when(F.col("__lines").isNotNull(), F.transform("__starts", chunk))
    return starts.withColumn("__chunks", chunks).drop("__lines", "__hashes", "__starts")


def dedup_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df with repeated chunks cut from its texts, and n_lines and n_removed (lines). A text may get empty. Such columns of df are replaced."""
    chunks = _with_chunks(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    chunks = chunks.select("doc_id", F.explode_outer("__chunks").alias("c")).where("c.checked").select("doc_id", "c.pos", F.xxhash64("c.body").alias("hash"), "c.body")
    hashes = chunks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    repeated = written(chunks.join(hashes, "hash"))
    place = F.struct("doc_id", "pos")
    firsts = repeated.groupBy("hash", "body").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = repeated.join(firsts, ["hash", "body"]).where(place > F.col("first")).where("doc_id is not null")
    gone = again.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.struct("pos", "hash")).alias("__gone"))
    met = _with_chunks(df, text).join(gone, F.col(doc_id) == F.col("__id"), "left")
    goes = lambda c: F.col("__gone").isNotNull() & c["checked"] & F.array_contains("__gone", F.struct(c["pos"].alias("pos"), F.xxhash64(c["body"]).alias("hash")))
    kept = met.withColumn("__kept", F.filter("__chunks", lambda c: ~F.coalesce(goes(c), F.lit(False))))
    lines = lambda cs: F.coalesce(F.aggregate(cs, F.lit(0).cast("long"), lambda n, c: n + c["lines"]), F.lit(0).cast("long"))
    found = F.struct(F.array_join(F.transform("__kept", lambda c: c["body"]), "\n").alias("text"), lines(F.col("__chunks")).alias("all"), lines(F.col("__kept")).alias("kept"))
    # a generator, through which no filter moves: moved, it would work out the chunks again for each line
    out = kept.withColumn("__found", F.explode_outer(F.array(found)))
    out = out.withColumns({text: F.col("__found.text"), "n_lines": F.col("__found.all"), "n_removed": F.col("__found.all") - F.col("__found.kept")})
    return out.drop("__id", "__gone", "__chunks", "__kept", "__found")


def without_repeated_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df with repeated chunks cut from its texts, without the documents of which every line went; columns as before."""
    out = dedup_lines(df, text, doc_id)
    return out.where("n_removed = 0 or n_removed < n_lines").select(*df.columns)


def _windows(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, copy, first, last, hash of the least run of LONG_WORDS words that begins at each line, and that ends at each line."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("copy"), F.split(text, "\n", -1).alias("lines"))
    worded = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.regexp_count(x, F.lit(r"\S+")).alias("n"))), lambda x: x["n"] > 0)
    # generators, through which nothing is moved into the loops below
    rows = rows.select("doc_id", "copy", F.explode(F.array(F.struct("lines", worded.alias("worded")))).alias("r")).select("doc_id", "copy", "r.*").where(F.size("worded") > 0)

    def run(lines_of):  # a line with words has one at least, so LONG_WORDS of them are enough
        return F.aggregate(lines_of, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("i")), lambda a, x: F.when(a["n"] >= LONG_WORDS, a).otherwise(F.struct((a["n"] + x["n"]).alias("n"), x["i"].alias("i"))))

    def forwards(x, k):
        return F.transform(F.array(run(F.slice("worded", k + 1, LONG_WORDS))), lambda r: F.struct(r["n"].alias("n"), x["i"].alias("first"), r["i"].alias("last")))

    def backwards(x, k):
        before = F.slice("worded", F.greatest(k + 2 - LONG_WORDS, F.lit(1)), F.least(k + 1, F.lit(LONG_WORDS)))
        return F.transform(F.array(run(F.reverse(before))), lambda r: F.struct(r["n"].alias("n"), r["i"].alias("first"), x["i"].alias("last")))

    ranges = F.filter(F.flatten(F.concat(F.transform("worded", forwards), F.transform("worded", backwards))), lambda r: r["n"] >= LONG_WORDS)
    ranges = F.array_distinct(F.transform(ranges, lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"))))
    rows = rows.select("doc_id", "copy", F.explode(F.array(F.struct("lines", ranges.alias("ranges")))).alias("r")).select("doc_id", "copy", "r.*")
    body = lambda r: F.array_join(F.slice("lines", r["first"] + 1, r["last"] - r["first"] + 1), "\n")
    found = F.transform("ranges", lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"), F.unhex(F.sha2(body(r).cast("binary"), 256)).alias("hash")))
    return rows.select("doc_id", "copy", F.explode(found).alias("w")).select("doc_id", "copy", "w.*")


def without_repeated_passages(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df without the lines of runs of LONG_WORDS words or more that stand, line by line, at an earlier (doc_id, line) too.

    However the lines around it are cut: such a run is the union of the windows of _windows that lie in it. Equal are
    windows of one SHA-256. A window that overlaps its first copy stays, so that a repeated line keeps one whole run. Documents
    that lose all their words go. Rows with a null doc_id lose nothing."""
    scratch = Scratch(df.sparkSession)
    windows = scratch.written(_windows(df, text, doc_id))
    firsts = windows.groupBy("hash").agg(F.min(F.struct("doc_id", "first", "last", "copy")).alias("of"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = windows.join(firsts, "hash").where("doc_id is not null").where(F.struct("doc_id", "first") > F.struct("of.doc_id", "of.first"))
    again = again.where("not (of.doc_id <=> doc_id and of.copy = copy and of.last >= first)")
    gone = again.select("doc_id", "copy", F.explode(F.sequence("first", "last")).alias("i")).groupBy(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy")).agg(F.collect_set("i").alias("__gone"))
    gone = scratch.written(gone)
    scratch.drop(windows)
    # one plan at all sizes: texts are dealt out once, whether what goes from them is little or much
    gone = gone.hint("merge")
    met = df.join(gone, (df[doc_id] == gone["__id"]) & (F.xxhash64(df[text]) == gone["__copy"]), "left")
    # a generator, so that a text is split once, not for each of its lines
    split = met.withColumn("__lines", F.explode_outer(F.array(F.when(F.col("__gone").isNotNull(), F.split(F.col(text), "\n", -1)))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.when(F.col("__gone").isNotNull(), F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n"))
    out = split.withColumn("__kept", F.explode_outer(F.array(kept))).where("__kept is null or __kept rlike '[^ \\t\\r\\n]'")
    return out.withColumn(text, F.coalesce("__kept", F.col(text))).select(*df.columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = """
with l as (
  select doc_id, i, line, cast('0x' || substr(md5(line), 1, 6) as integer) as h, length(line) - length(replace(line, ' ', '')) >= 49 as long
  from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents)),
b as (
  select *, i = 0 or long or lag(long, 1, false) over w
    or (7 * h + lead(h, 1, 0) over w) % 5 = 0
    or (7 * lag(h, 1, 0) over w + lag(h, 2, 0) over w) % 5 = 0 as begins
  from l window w as (partition by doc_id order by i)),
p as (select *, sum(begins::int) over (partition by doc_id order by i) - 1 as pos from b),
c as (
  select doc_id, pos, string_agg(line, chr(10) order by i) as body, count(*) as lines,
         count(*) filter (line <> '') >= 2 or bool_or(long) as checked
  from p group by doc_id, pos),
f as (select body, min(row(doc_id, pos)) as first from c where checked group by body),
k as (select c.*, checked and row(doc_id, pos) > first as gone from c left join f using (body)),
r as (
  select doc_id, coalesce(string_agg(body, chr(10) order by pos) filter (not gone), '') as text,
         cast(sum(lines) as bigint) as n_lines, cast(coalesce(sum(lines) filter (gone), 0) as bigint) as n_removed
  from k group by doc_id)
select d.doc_id, r.text, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed
from documents d left join r using (doc_id)
"""
