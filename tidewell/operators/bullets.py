"""Bullet lists of documents as summary blocks: lines as rows, windows over them, containment inside a run.

Everything is a built-in expression. A line's neighbours come by windows; the text from a line to the end of its sentence is cut
out of the block's joined text by running lengths. Only two choices depend on what was chosen before them (a bullet that
takes over the next lines, a sentence that repeats an earlier one): they are folds over a block's or a document's few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import strip

# Marks, limits and words of the rules.
MARK = r"(?U)^[•·\-–—*]\s*"
STEP = r"(?U)^\d+\s*[.、．]"
END = "[。！？；]$"
REQUIREMENT = "请|勿|不要|建议|需|禁止|必须|确保|切勿|应"
PERIODIC = r"(?U)每\s*\d+(?:\.\d+)?\s*(?:个)?月|每周|每月|长期|存放|储存|休眠|唤醒|待机|补充电"
NOTICE = "^(温馨提示|注意|警告|提示)[：:]?"
SHORTEST, LONGEST, LONGEST_CONTEXT = 12, 100, 90
JOINED_LINES, DENSE, GAP, AROUND, OWN_KEY = 3, 5, 3, 3, 10

BLOCK = ["doc_id", "seq"]


def _ends(text: Column) -> Column:
    return text.rlike(END)


def _ended(text: Column) -> Column:
    return F.when(_ends(text), text).otherwise(F.concat(text, F.lit("。")))


def _key(text: Column) -> Column:
    """A sentence without step number, notice word and blanks: what decides whether one contains another."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(text), STEP, ""), NOTICE, ""), r"(?U)\s+", "")


def block_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, seq, at, line, bare, numbered): stripped lines; ``bare`` without mark and step number where the line has
    one, else null. Documents are (doc_id, text) or blocks (doc_id, seq, text)."""
    rows = documents if "seq" in documents.columns else documents.withColumn("seq", F.lit(0))
    rows = rows.select(*BLOCK, F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line", strip("line"))
    unmarked = F.regexp_replace("line", MARK, "")
    numbered = unmarked.rlike(STEP)
    bare = F.when(numbered | (unmarked != F.col("line")), strip(F.regexp_replace(unmarked, STEP, "")))
    return rows.select(*BLOCK, "at", "line", bare.alias("bare"), numbered.alias("numbered"))


def bullet_items(lines: DataFrame) -> DataFrame:
    """(doc_id, seq, at, text, numbered): marked or numbered lines of 12 to 100 characters. One that doesn't end a sentence
    takes over up to three following lines, to the next blank one at most, and must end with them."""
    order = Window.partitionBy(*BLOCK).orderBy("at")
    text, last, open_ = F.col("bare"), F.lit(0), F.lit(True)
    for k in range(1, JOINED_LINES + 1):
        following = F.lead("line", k).over(order)
        open_ = open_ & ~_ends(text) & (F.length(text) < LONGEST) & F.coalesce(following != "", F.lit(False))
        lines = lines.withColumns({f"open{k}": open_, f"text{k}": F.when(open_, F.concat(text, F.regexp_replace(following, MARK, ""))).otherwise(text)})
        text, open_ = F.col(f"text{k}"), F.col(f"open{k}")
        last = last + open_.cast("int")
    whole = F.col("bare").isNotNull() & (F.col("bare") != "") & F.length(text).between(SHORTEST, LONGEST) & ((last == 0) | _ends(text))
    found = lines.select(*BLOCK, "at", (F.col("at") + last).alias("last"), text.alias("text"), "numbered", whole.alias("whole")).filter("whole").drop("whole")
    entry = F.struct("at", "last", "text", "numbered")
    kind = "array<struct<at:int,last:int,text:string,numbered:boolean>>"
    free = F.aggregate(F.array_sort(F.collect_list(entry)), F.array().cast(kind), lambda kept, x: F.when(F.coalesce(F.try_element_at(kept, F.lit(-1))["last"], F.lit(-1)) < x["at"], F.concat(kept, F.array(x))).otherwise(kept))
    return found.groupBy(*BLOCK).agg(free.alias("items")).select(*BLOCK, F.explode("items").alias("x")).select(*BLOCK, "x.at", "x.text", "x.numbered")


def dense_runs(items: DataFrame) -> DataFrame:
    """``items`` with ``run``: those with another one within five lines, numbered anew after a gap of more than three;
    runs of one item are none."""
    order = Window.partitionBy(*BLOCK).orderBy("at")
    before, after = F.col("at") - F.lag("at").over(order), F.lead("at").over(order) - F.col("at")
    rows = items.withColumn("near", F.least(before, after)).filter(F.col("near") <= DENSE)
    opens = F.coalesce(F.col("at") - F.lag("at").over(order) > GAP, F.lit(True))
    rows = rows.drop("near").withColumn("run", F.sum(opens.cast("int")).over(order))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy(*BLOCK, "run"))).filter("n > 1").drop("n")


def requirements(lines: DataFrame) -> DataFrame:
    """(doc_id, seq, at, text): whole sentences of 12 to 90 characters that ask for something, from an unmarked line to the
    first line that ends a sentence, over blank lines too."""
    order = Window.partitionBy(*BLOCK).orderBy("at")
    rows = lines.filter(F.col("line") != "").withColumn("upto", F.sum(F.length("line")).over(order))
    rows = rows.withColumn("end", F.first(F.when(_ends(F.col("line")), F.col("upto")), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumns({"start": F.col("upto") - F.length("line"), "size": F.col("end") - F.col("upto") + F.length("line")})
    joined = lines.groupBy(*BLOCK).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "").alias("joined"))
    found = rows.filter(F.col("bare").isNull() & F.col("size").between(SHORTEST, LONGEST_CONTEXT)).join(joined, BLOCK)
    found = found.select(*BLOCK, "at", F.substring("joined", (F.col("start") + 1).cast("int"), F.col("size").cast("int")).alias("text"))
    return found.filter(F.col("text").rlike(REQUIREMENT))


def _members(lines: DataFrame) -> DataFrame:
    """A row per run: its items and the requirements up to three lines around it, in lines' order, as ``members`` (at, text,
    numbered, context, key); repeats of an item among the requirements are none."""
    runs = dense_runs(bullet_items(lines))
    item = F.struct("at", "text", "numbered", F.lit(False).alias("context"), _key(F.col("text")).alias("key"))
    own = runs.groupBy(*BLOCK, "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.collect_list(item).alias("items"))
    near = requirements(lines).withColumnRenamed("at", "line_at").join(own.select(*BLOCK, "run", "first", "last"), BLOCK).filter(F.col("line_at").between(F.col("first") - AROUND, F.col("last") + AROUND))
    asked = F.struct(F.col("line_at").alias("at"), "text", F.lit(False).alias("numbered"), F.lit(True).alias("context"), _key(F.col("text")).alias("key"))
    around = near.groupBy(*BLOCK, "run").agg(F.collect_list(asked).alias("around"))
    rows = own.join(around, [*BLOCK, "run"], "left")
    others = F.filter(F.coalesce("around", F.filter("items", lambda x: F.lit(False))), lambda x: ~F.exists("items", lambda y: y["text"] == x["text"]))
    return rows.select(*BLOCK, "run", F.array_sort(F.concat("items", others)).alias("members"))


def _not_contained(members: Column) -> Column:
    """Members whose key of ten characters and more stands in no longer member's; of equal ones an item, then the first, stays."""

    def holds(y: Column, x: Column) -> Column:
        earlier = (y["context"] < x["context"]) | ((y["context"] == x["context"]) & (y["at"] < x["at"]))
        return F.contains(y["key"], x["key"]) & ((F.length(y["key"]) > F.length(x["key"])) | ((y["key"] == x["key"]) & earlier))

    return F.filter(members, lambda x: (F.length(x["key"]) < OWN_KEY) | ~F.exists(members, lambda y: holds(y, x)))


def _lone_sentences(runs: DataFrame) -> DataFrame:
    """(doc_id, seq, run, n, text): sentences about storing and recurring care in a run's requirements and numbered items;
    one that contains an earlier one of the document, or is contained in it, is left out."""
    sources = F.concat(F.filter("members", lambda x: x["context"]), F.filter("kept", lambda x: x["numbered"]))
    rows = runs.select(*BLOCK, "run", F.posexplode(sources).alias("k", "source"))
    rows = rows.select(*BLOCK, "run", "k", F.posexplode(F.split("source.text", "(?<=[。！？])")).alias("j", "text")).withColumn("text", strip("text"))
    rows = rows.filter((F.length("text") >= SHORTEST) & F.col("text").rlike(PERIODIC)).withColumn("text", _ended(F.col("text")))
    entry = F.struct("seq", "run", "k", "j", "text", _key(F.col("text")).alias("key"))
    own = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    kind = dict(own.dtypes)["all"]

    def step(kept: Column, x: Column) -> Column:
        again = (F.length(x["key"]) >= OWN_KEY) & F.exists(kept, lambda y: F.contains(y["key"], x["key"]) | F.contains(x["key"], y["key"]))
        return F.when(again, kept).otherwise(F.concat(kept, F.array(x)))

    first = own.select("doc_id", F.posexplode(F.aggregate("all", F.array().cast(kind), step)).alias("n", "x"))
    return first.select("doc_id", "x.seq", "x.run", (F.col("n") + 1).alias("n"), "x.text")


def bullet_bodies(documents: DataFrame) -> DataFrame:
    """(doc_id, run, body): a document's runs in order, each as one text, followed by the sentences of it that stand for
    themselves; a text once in each document. Null texts have none."""
    runs = _members(block_lines(documents)).withColumn("kept", _not_contained(F.col("members")))
    bodies = runs.select(*BLOCK, "run", F.lit(0).alias("n"), F.array_join(F.transform("kept", lambda x: _ended(x["text"])), "；").alias("body"))
    rows = bodies.unionByName(_lone_sentences(runs).withColumnRenamed("text", "body"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "body").orderBy("seq", "run", "n"))).filter("nth = 1")
    return rows.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "run", "n")) - 1).alias("run"), "body")


def bullet_summary(documents: DataFrame) -> DataFrame:
    """(doc_id, run, text) '【要点清单】' blocks of ``bullet_bodies``; documents have ``filename``."""
    names = documents.select("doc_id", "filename").distinct()
    return bullet_bodies(documents).join(names, "doc_id").select("doc_id", "run", F.concat(F.lit("【要点清单】《"), "filename", F.lit("》"), "body").alias("text"))
