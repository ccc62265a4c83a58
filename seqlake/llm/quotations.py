"""Quotation linking, in DataFrame functions only.

A message's lines may be quoted: ``>`` once per level, blanks allowed between. Consecutive lines
of one level, without an empty line in between, are a passage. White space is ``[\\x20\\x09-\\x0D]``, so
lines may end in CR LF. Passages are normalised (lower case, runs of white space to one blank, ends
stripped) and hashed (SHA-256). A quoted passage
links to the message that holds it as its own text: inside the same scope (a conversation,
mailing list or folder) first, else anywhere, always to an earlier message.

The parent of a message is the latest original among its passages of the lowest quoted level
that has one. Roots and depths follow by pointer doubling over the messages that don't point to
their root yet, so the number of rounds is the logarithm of the longest chain of replies. The result is in reply order: root, depth, order.

Originals are aggregated to one row per (scope, hash), and per hash, before any join, so a
passage held by a third of all messages costs one row there; quotes of it are looked up in a
join whose other side is unique, with hot hashes salted (``skew``).

Defined results: a null or empty text has no own text and no quotes; repeated passages of one
message count once; of equal originals the earliest is taken, ties to the smaller id; messages
that quote nothing known are roots; rows repeated with one id are one message each and share
links, with the least (order, scope) of these rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.llm.scratch import Scratch
from seqlake.llm.skew import for_each_salt, hot_keys, with_salt

MARK = r"^(?:[\x20\x09]*>)+"
ENDS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """(id, level, hash) of the distinct passages of each message; level 0 is its own text.

    Equal rows are taken once; rows that share an id but not the text are cut apart.
    """
    messages = messages.withColumn("row", F.xxhash64("text")).dropDuplicates(["id", "row"])
    lines = F.split("text", "\n")
    mark = lambda x: F.regexp_extract(x, MARK, 0)
    level = lambda x: F.length(mark(x)) - F.length(F.replace(mark(x), F.lit(">"), F.lit("")))
    parsed = F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(F.substr(x, F.length(mark(x)) + 1), ENDS, "").alias("body")))
    rows = messages.withColumn("lines", parsed)
    # A passage starts where the level changes or after an empty line; lines are numbered by their passage.
    changed = lambda x, i: F.when(
        (i == 0) | (F.get("lines", i - 1)["level"] != x["level"]) | (F.get("lines", i - 1)["body"] == ""), 1).otherwise(0)
    each = rows.select("id", "row", F.posexplode(F.transform("lines", lambda x, i: F.struct(x["level"].alias("level"), x["body"].alias("body"), changed(x, i).alias("new")))).alias("pos", "x"))
    each = each.select("id", "row", "pos", "x.level", "x.body", F.sum("x.new").over(Window.partitionBy("id", "row").orderBy("pos")).alias("part"))
    each = each.groupBy("id", "row", "part", "level").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("lines"))
    each = each.select("id", "level", normalised(F.array_join(F.col("lines.body"), " ")).alias("passage")).where("passage <> ''")
    return each.select("id", "level", F.unhex(F.sha2("passage", 256)).alias("hash")).distinct()


def own_text(text: Column) -> Column:
    """A message without its quoted lines."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(MARK))
    return F.regexp_replace(F.array_join(kept, "\n"), ENDS, "")


def link(messages: DataFrame, id_col: str, text_col: str, order_col: str, scope_col: str) -> DataFrame:
    """(id, parent_id, level, passages): each replying message's parent."""
    scratch = Scratch(messages.sparkSession, "quotes")
    rows = messages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(order_col).alias("at"), F.col(scope_col).alias("scope"))
    where = rows.groupBy("id").agg(F.min(F.struct("at", "scope")).alias("x")).select("id", "x.at", "x.scope")
    found = scratch.save(passages(rows.select("id", "text")).join(where, "id"), "passages")
    own = found.where("level = 0")
    first = F.min(F.struct("at", "id")).alias("first")
    in_scope = own.groupBy("scope", "hash").agg(first)
    anywhere = own.groupBy("hash").agg(first.alias("any_first"))
    quoted = found.where("level > 0")
    hot = scratch.save(hot_keys(quoted.groupBy("hash").agg(F.count("*").alias("n")), found.count()), "hot")
    quoted = with_salt(quoted, hot, F.col("id"))
    quotes = quoted.join(for_each_salt(in_scope, hot), ["scope", "hash", "salt"], "left").join(for_each_salt(anywhere, hot), ["hash", "salt"], "left")
    earlier = lambda c: F.when(F.struct(f"{c}.at", f"{c}.id") < F.struct("at", "id"), F.col(c))
    hits = quotes.select("id", "level", F.coalesce(earlier("first"), earlier("any_first")).alias("original")).where("original IS NOT NULL")
    levels = hits.groupBy("id", "level").agg(F.max("original").alias("parent"), F.count("*").alias("passages"))
    best = levels.groupBy("id").agg(F.min(F.struct("level", "parent", "passages")).alias("x"))
    best = best.select("id", F.col("x.parent.id").alias("parent_id"), F.col("x.level").alias("level"), F.col("x.passages").alias("passages"))
    best = scratch.save(best, "links")
    scratch.drop(found)
    return best


def conversations(messages: DataFrame, id_col: str = "id", text_col: str = "text", order_col: str = "at", scope_col: str = "scope") -> DataFrame:
    """One row per message, sorted in reply order inside range partitions:
    (id, parent_id, root_id, depth, linked_passages, own_text)."""
    scratch = Scratch(messages.sparkSession, "replies")
    links = link(messages, id_col, text_col, order_col, scope_col)
    moving = scratch.save(links.select("id", F.col("parent_id").alias("up"), F.lit(1).alias("depth")), "hops")
    done, known = [], moving
    while True:  # a message leaves as soon as it points to its root, so each round joins fewer rows
        above = known.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        joined = moving.join(above, "up", "left").select(
            "id", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")
        )
        joined = scratch.save(joined, "hops")
        done.append(joined.where("NOT moved").drop("moved"))
        moving = joined.where("moved").drop("moved")
        if moving.isEmpty():
            break
        known = reduce(DataFrame.unionByName, done, moving)
    hops = reduce(DataFrame.unionByName, done)
    rows = messages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(order_col).alias("at"))
    out = rows.join(links, "id", "left").join(hops.select("id", F.col("up").alias("root_id"), "depth"), "id", "left")
    out = out.select(
        F.col("id").alias(id_col), "parent_id", F.coalesce("root_id", "id").alias("root_id"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("passages", F.lit(0)).cast("long").alias("linked_passages"), F.coalesce(own_text(F.col("text")), F.lit("")).alias("own_text"), "at",
    )
    out = out.repartitionByRange("root_id", "depth", "at", id_col).sortWithinPartitions("root_id", "depth", "at", id_col)
    return out.drop("at") if order_col != "at" else out


def mail_from_turns(turns: DataFrame) -> DataFrame:
    """Messages (id, at, scope, text) from turns: each quotes the two turns before it, nested.

    A turn's own text is followed by the one before as level 1 and the one before that as level 2. A
    message's id is the struct (conv_id, turn). Of rows that share both the least text is the turn's
    (a null one counts as empty); a row without conv_id or turn is no turn of a conversation and is left out.
    """
    own = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    own = own.groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    quote = lambda c, m: F.regexp_replace(F.col(c), r"(?md)^", m)
    back = lambda n: own.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(f"back{n}"))
    joined = own.join(back(1), ["conv_id", "turn"], "left").join(back(2), ["conv_id", "turn"], "left")
    text = F.concat_ws("\n", "text", quote("back1", "> "), quote("back2", ">> "))
    return joined.select(F.struct("conv_id", "turn").alias("id"), F.col("turn").alias("at"), F.col("conv_id").alias("scope"), text.alias("text"))


def op3_quotation_linking(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    out = conversations(mail_from_turns(turns))
    number = lambda c: (F.shiftleft(F.col(c)["conv_id"], 20) + F.col(c)["turn"])
    return out.select(
        number("id").alias("message_id"), number("parent_id").alias("parent_id"), number("root_id").alias("root_id"), "depth", "linked_passages",
        F.sha2("own_text", 256).alias("own_sha256"), "id.conv_id", "id.turn",
    )


OP3_SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
m AS (
  SELECT (c.conv_id << 20) + c.turn AS id, c.conv_id, c.turn, c.turn AS t, c.conv_id AS scope,
    concat_ws(chr(10), c.text, regexp_replace(x.text, '(?m)^', '> ', 'g'), regexp_replace(y.text, '(?m)^', '>> ', 'g')) AS text
  FROM c LEFT JOIN c x ON x.conv_id = c.conv_id AND x.turn = c.turn - 1 LEFT JOIN c y ON y.conv_id = c.conv_id AND y.turn = c.turn - 2),
raw AS (SELECT id, t, scope, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM m),
l AS (SELECT *, length(mark) - length(replace(mark, '>', '')) AS level, regexp_replace(substr(line, length(mark) + 1), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body FROM (SELECT *, regexp_extract(line, '^(?:[\x20\x09]*>)+') AS mark FROM raw)),
n AS (SELECT *, CASE WHEN pos = 0 OR lag(level) OVER w <> level OR lag(body) OVER w = '' THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY id ORDER BY pos)),
q AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY pos) AS part FROM n),
p AS (SELECT DISTINCT id, t, scope, level, passage FROM (
  SELECT id, t, scope, level, trim(regexp_replace(lower(string_agg(body, ' ' ORDER BY pos)), '[\x20\x09-\x0D]+', ' ', 'g')) AS passage FROM q GROUP BY id, t, scope, level, part) WHERE passage <> ''),
s AS (SELECT scope, passage, min({'t': t, 'id': id}) AS f FROM p WHERE level = 0 GROUP BY scope, passage),
a AS (SELECT passage, min({'t': t, 'id': id}) AS f FROM p WHERE level = 0 GROUP BY passage),
h AS (SELECT p.id, p.level, coalesce(CASE WHEN s.f < {'t': p.t, 'id': p.id} THEN s.f END, CASE WHEN a.f < {'t': p.t, 'id': p.id} THEN a.f END) AS o
  FROM p LEFT JOIN s ON p.scope = s.scope AND p.passage = s.passage LEFT JOIN a ON p.passage = a.passage WHERE p.level > 0),
b AS (SELECT id, level, max(o).id AS parent, count(*) AS passages, row_number() OVER (PARTITION BY id ORDER BY level) AS k FROM h WHERE o IS NOT NULL GROUP BY id, level),
up AS (SELECT id, parent, passages FROM b WHERE k = 1),
r AS (SELECT m.id, m.id AS root, 0 AS depth FROM m WHERE id NOT IN (SELECT id FROM up) UNION ALL SELECT up.id, r.root, r.depth + 1 FROM r JOIN up ON up.parent = r.id),
own AS (SELECT id, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (mark = ''), ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS own FROM l GROUP BY id)
SELECT r.id AS message_id, up.parent AS parent_id, r.root AS root_id, r.depth, coalesce(up.passages, 0) AS linked_passages, sha256(own.own) AS own_sha256, m.conv_id, m.turn
FROM r JOIN m ON r.id = m.id LEFT JOIN up ON r.id = up.id JOIN own ON r.id = own.id
"""
