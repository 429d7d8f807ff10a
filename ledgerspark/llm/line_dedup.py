"""Line dedup: later repeats of a run of lines are deleted, by winnowing over line hashes.

A line here ends at a line break or behind a sign that ends a sentence or clause, so that a passage pasted into a
longer line is still found; the last `least` characters before an end must hold no other end, so lines shorter
than that join what follows. Where lines end depends on these few characters alone, hence a passage falls into
the same lines wherever it stands.

A gram is a shortest run of lines of a given weight (its characters, one more a line). Winnowing selects the
minimum of every window of grams, with its position, and two places with a common run of `run` characters have
such a minimum in common. Selected grams are joined by hash, and only positions whose gram is selected elsewhere
too are extended: the shortest runs of `run` characters around them, from their first line forwards and from
their last line backwards, are joined by their hashes to the first place of the same lines in the order (doc_id,
position). The union of the runs that match at consecutive places is the match extended both ways, down to the
last equal line; all its lines are deleted but those of the first place. Only first places are joined to, never
pairs of places, so a passage in a third of all documents costs a row each.

Defined results: null texts stay null and empty ones empty; a document all of whose lines repeat earlier ones
keeps its row with an empty text; null doc_ids come first; rows equal in doc_id and text are one document, and
what is decided for it holds for each of them; a repeat that overlaps its own first place keeps the first; other columns
are kept, n_chars is set to the new length, and a column already named n_removed is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read

#: Characters that a line has at least, apart from a text's last line.
LEAST = 16
#: Weight of a repeated run and of the grams that are winnowed; a window extends over what is left.
RUN, GRAM = 160, 64
SIGNS = "[.,!?;:\u2026]"


def _ends(least: int) -> tuple[str, str]:
    """Patterns of the character that ends a line, and of the place behind it."""
    back = f"(?<=[^\\n]{{{least}}}[ \\n])(?<!{SIGNS} [^\\n]{{0,{least - 1}}}[ \\n])"
    return f"(?: (?<={SIGNS} )|\\n){back}", f"(?<={SIGNS} |\\n){back}"


def _sum(columns: list[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


def _gram(i: Column, weight: int, step: int, least: int) -> Column:
    """(start, n, g) of the shortest run of lines of that weight from line i on (step 1) or up to it (step -1); null if none.

    Runs up to a line that are also runs from a line on are left to the latter.
    """
    longest = -(-weight // (least + 1))
    found = F.lit(None).cast("struct<start:int,n:int,g:bigint>")
    for n in range(longest, 0, -1):
        at = [i + step * k for k in range(n)]
        heavy = _sum([F.get("w", p) for p in at])
        at = at[::step]
        here = F.struct(at[0].cast("int").alias("start"), F.lit(n).alias("n"), F.xxhash64(*(F.get("h", p) for p in at)).alias("g"))
        if step < 0:
            here = F.when(heavy - F.get("w", i) >= weight, here)
        found = F.when(heavy >= weight, here).otherwise(found)
    return found


def _lines(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """(doc_id, key, h, w) for every text that has a line: hashes and weights of its lines."""
    units = F.split(docs[f"`{text}`"], _ends(least)[0])
    rows = docs.where(F.length(docs[f"`{text}`"]) > 0).select(docs[f"`{doc_id}`"].alias("doc_id"), F.xxhash64(docs[f"`{text}`"]).alias("key"), units.alias("units"))
    return rows.select("doc_id", "key", F.transform("units", lambda u: F.xxhash64(u)).alias("h"), F.transform("units", lambda u: F.length(u) + 1).alias("w"))


def _winnowed(lines: DataFrame, gram: int, window: int, least: int) -> DataFrame:
    """(doc_id, key, at, g): a row for each line whose gram is the minimum of a window that covers it."""
    grams = lines.select("doc_id", "key", "w", F.transform("h", lambda x, i: _gram(i, gram, 1, least)["g"]).alias("g"))
    reach = range(1, -(-window // (least + 1)))

    def lowest(x: Column, i: Column) -> Column:
        ahead = F.lit(None).cast("long")
        for k in reversed(reach):
            ahead = F.when(_sum([F.get("w", i + j) for j in range(k)]) < window, F.least(F.get("g", i + k), ahead))
        return F.least(x, ahead)

    windows = grams.withColumn("m", F.transform("g", lowest))

    def chosen(x: Column, i: Column) -> Column:
        before = F.lit(False)
        for k in reversed(reach):
            covered = _sum([F.get("w", i - j) for j in range(1, k + 1)]) < window
            before = F.when(covered, (F.get("m", i - k) == x) | before).otherwise(F.lit(False))
        return F.when((F.get("m", i) == x) | before, F.struct(i.alias("at"), x.alias("g")))

    selected = F.filter(F.transform("g", chosen), lambda x: x.isNotNull())
    return windows.select("doc_id", "key", F.explode(selected).alias("s")).select("doc_id", "key", "s.at", "s.g")


def _marks(positions: Column) -> Column:
    """An array with "1" at the given sorted positions and "0" at those before and between them."""
    return F.split(F.array_join(F.transform(positions, lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.when(i > 0, F.get(positions, i - 1)).otherwise(-1) - 1), F.lit("1"))), ""), "")


def _places(lines: DataFrame, run: int, least: int) -> DataFrame:
    """(doc_id, key, start, n, g): the shortest runs of weight `run`, forwards and backwards, that hold a marked line."""
    held = lambda r: r.isNotNull() & F.exists(F.slice("marks", r["start"] + 1, r["n"]), lambda m: m == "1")
    runs = F.concat(F.transform("h", lambda x, i: _gram(i, run, 1, least)), F.transform("h", lambda x, i: _gram(i, run, -1, least)))
    return lines.select("doc_id", "key", F.explode(F.filter(runs, held)).alias("r")).select("doc_id", "key", "r.start", "r.n", "r.g")


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, gram: int = GRAM, least: int = LEAST) -> DataFrame:
    """(doc_id, key, removed): the line numbers, from 0, to delete from the text whose xxhash64 is key."""
    lines = materialize(_lines(docs, doc_id, text, least), "lines")
    anchors = materialize(_winnowed(lines, gram, run - gram, least), "anchors")
    again = anchors.groupBy("g").agg(F.count("*").alias("times")).where("times > 1").select("g")
    shared = anchors.join(again, "g", "left_semi").groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("at")).alias("positions"))
    shared = materialize(shared, "shared").select(F.col("doc_id").alias("s_id"), F.col("key").alias("s_key"), _marks(F.col("positions")).alias("marks"))
    open_ = lines.join(shared, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("key") == F.col("s_key"))).drop("s_id", "s_key")
    places = materialize(_places(open_, run, least), "places")
    firsts = places.groupBy("g").agg(F.min(F.struct("doc_id", "key", "start")).alias("first"), F.count("*").alias("times")).where("times > 1").select("g", "first")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    later = places.join(firsts, "g").where(~(own & (F.col("start") == F.col("first.start"))))
    since = F.when(own, F.greatest(F.col("start"), F.col("first.start") + F.col("n"))).otherwise(F.col("start"))
    spans = later.select("doc_id", "key", since.alias("a"), (F.col("start") + F.col("n") - 1).alias("b")).where("a <= b")
    lines_of = F.array_distinct(F.flatten(F.collect_list(F.sequence("a", "b"))))
    return spans.groupBy("doc_id", "key").agg(lines_of.alias("removed"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, gram: int = GRAM, least: int = LEAST) -> DataFrame:
    """docs with repeated lines deleted from text, and n_removed, how many these were."""
    gone = materialize(repeated_lines(docs, doc_id, text, run, gram, least), "removed").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "removed")
    whole = docs[f"`{text}`"]
    joined = docs.join(gone.withColumnRenamed("removed", "_removed"), docs[f"`{doc_id}`"].eqNullSafe(F.col("_id")) & (F.xxhash64(whole) == F.col("_key")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("_units") - 1), "_removed")
    new = F.when(F.col("_removed").isNull(), F.col(f"`{text}`")).otherwise(F.concat_ws("", F.transform(kept, lambda i: F.get("_units", i))))
    split = joined.withColumn("_units", F.when(F.col("_removed").isNotNull(), F.split(F.col(f"`{text}`"), _ends(least)[1])))
    columns = [c for c in docs.columns if c != "n_removed"]
    found = split.select(*(new.alias(c) if c == text else F.col(f"`{c}`") for c in columns), F.coalesce(F.array_size("_removed"), F.lit(0)).cast("long").alias("n_removed"))
    return found.withColumn("n_chars", F.length(F.col(f"`{text}`")).cast("long")) if "n_chars" in columns else found


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
