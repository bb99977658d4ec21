"""Chat formatting by quotation linking, in DataFrame operations alone.

Lines that begin with ">" are quoted, as deep as they have such marks. Quoted lines of a message are
normalised (marks dropped, lower case, white space joined), hashed, and joined to the first message of the
conversation that holds the line unquoted, if it came before. The message replied to is the one that most
lines of the shallowest linked level come from (of equals the latest). Replies form trees: every message gets
its thread's first turn, its depth in replies, and its text without quotes; sorting by (conv_id, thread, depth,
turn) gives reply order: a message follows the one that it replies to. Only linked messages take part in the
doubling that finds roots, and no row grows with a thread's length.

Defined cases: a null or empty text has no lines and is kept, empty; a message without linked quotes begins
a thread; a line that only quotes itself or later messages links nothing; rows that repeat a turn share the
turn's links, each row is kept; a null conv_id or turn links nothing and has no thread; very long texts are
split in place; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

MARKS = r"^[ \t]*(?:>[ \t]*)+"


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\r?\n")


def _depth(line: Column) -> Column:
    return F.when(line.contains(">"), F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[^>]", ""))).otherwise(0)


def _plain(line: Column) -> Column:
    bare = F.when(line.contains(">"), F.regexp_replace(line, MARKS, "")).otherwise(line)
    return F.trim(F.regexp_replace(F.lower(bare), r"\s+", " "))


def links(conversations: DataFrame) -> DataFrame:
    """conv_id, turn and the turn it replies to, of the messages whose quotes are found. Lines are written once."""
    keyed = conversations.where("conv_id is not null and turn is not null")
    each = keyed.select("conv_id", "turn", F.explode(_lines()).alias("x")).select("conv_id", "turn", _depth(F.col("x")).alias("depth"), _plain(F.col("x")).alias("norm")).where("norm <> ''")
    each = cut(each.select("conv_id", "turn", "depth", F.unhex(F.md5(F.col("norm").cast("binary"))).alias("line")))
    quotes = each.where("depth > 0").groupBy("conv_id", "turn", "depth", "line").agg(F.count("*").alias("n"))
    first = each.where("depth = 0").join(each.where("depth > 0").select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id", "line").agg(F.min("turn").alias("source"))
    found = quotes.join(first, ["conv_id", "line"]).where("source < turn")
    votes = found.groupBy("conv_id", "turn", "depth", "source").agg(F.sum("n").alias("n"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("depth"), "n", "source")).alias("b"))
    return cut(best.select("conv_id", "turn", F.col("b.source").alias("reply_to")), each)


def roots(parents: DataFrame) -> DataFrame:
    """conv_id, turn, thread (the root's turn) and depth of all linked messages, by doubling: up is an ancestor, depth
    steps away; it ends when no ancestor has one itself."""
    now, old = parents.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth")), []
    while True:
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        new = cut(now.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), *old)
        now, old = new.drop("moved"), [new]
        if new.where("moved").isEmpty():
            return now.withColumnRenamed("up", "thread")


def quote_threads(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, n_quoted, max_level, reply_to, thread and depth of every row."""
    parents = links(conversations)
    trees = parents.join(roots(parents), ["conv_id", "turn"])
    seen = conversations.select("conv_id", "turn", "role", F.transform(_lines(), lambda x: F.struct(_depth(x).alias("depth"), x.alias("raw"))).alias("lines"))
    own = F.filter("lines", lambda x: x["depth"] == 0)
    rows = seen.select(
        "conv_id", "turn", "role", F.trim(F.array_join(F.transform(own, lambda x: x["raw"]), "\n")).alias("text"),
        F.size(F.filter("lines", lambda x: x["depth"] > 0)).cast("long").alias("n_quoted"), F.array_max(F.transform("lines", lambda x: x["depth"])).cast("long").alias("max_level"),
    )
    thread = F.when(F.col("conv_id").isNotNull(), F.coalesce("thread", "turn")).cast("long").alias("thread")
    return rows.join(trees, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "text", "n_quoted", "max_level", F.col("reply_to").cast("long").alias("reply_to"), thread, F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def with_quotes(conversations: DataFrame) -> DataFrame:
    """Messages that quote, made of a table whose messages don't: turn t, unless t % 4 is 0, begins with the lines of
    turn t - 1 after "> "; where t % 4 is 3 those of turn t - 2, after ">> ", stand before them."""
    text = F.coalesce("text", F.lit(""))
    plain = conversations.groupBy("conv_id", "turn").agg(F.min(text).alias("text"))

    def before(steps: int, mark: str) -> DataFrame:
        quoted = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit(mark), x)), "\n")
        return plain.select("conv_id", (F.col("turn") + steps).alias("turn"), F.concat(quoted, F.lit("\n")).alias(f"quote{steps}"))

    one, two = before(1, "> "), before(2, ">> ").where("turn % 4 = 3")
    both = conversations.select("conv_id", "turn", "role", text.alias("text")).join(one.where("turn % 4 <> 0"), ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
    return both.select("conv_id", "turn", "role", F.concat(F.coalesce("quote2", F.lit("")), F.coalesce("quote1", F.lit("")), "text").alias("text"))


def op6_quotation_linking(spark, sf_dir: str) -> DataFrame:
    """The tables' messages hold no quotes, so they are made to quote first."""
    return quote_threads(cut(with_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
