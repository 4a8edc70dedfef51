"""Chat formatting by quotation linking. DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, staged, table

#: Quote marks at the start of a line.
MARKS = r"^(?:[ \t]*>)+"
#: Orders that one task looks through together for the original of a passage.
BLOCK = 1024
#: Messages in one row of ``chats``.
CHAT_PART = 256
#: Stands for one quote mark while lines are told apart; in a text itself it is a blank.
LEVEL = "\x01"
#: Consecutive lines of one quote level, none of them blank. Possessive, so the matcher keeps no states.
PARAGRAPH = rf"(?md)^({LEVEL}*+)(?=[^\n]*[^ \t\r\n])[^\n]*+(?:\n\1(?!{LEVEL})(?=[^\n]*[^ \t\r\n])[^\n]*+)*+"


def own_text(text: Column) -> Column:
    """The text without its quoted lines, and without blank lines around it."""
    kept = F.filter(F.split(text, "\n"), lambda s: ~s.rlike(MARKS))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^(?:[ \t\r]*\n)+|(?:\n[ \t\r]*)+$", "")


def key_of(lines: Column) -> list[Column]:
    """128 bits of a passage: white space runs are one space, letters lower-cased."""
    norm = F.lower(F.trim(F.regexp_replace(lines, r"\s+", " ")))
    return [F.xxhash64(norm).alias("h1"), F.xxhash64(F.lit(3), norm).alias("h2")]


def _paragraphs(text: Column) -> Column:
    """``level, body`` of every paragraph of every quote level.

    The level of a line is the number of its quote marks. Lines of other levels are as good as blank ones: a
    paragraph ends where the level changes.
    """
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit(LEVEL), F.lit(" ")), "\n")
    level = lambda s: F.length(F.regexp_replace(F.regexp_extract(s, MARKS, 0), "[^>]", ""))
    marked = F.transform(lines, lambda s: F.when(s.rlike(MARKS), F.concat(F.repeat(F.lit(LEVEL), level(s)), F.regexp_replace(s, MARKS + "[ \t]?", ""))).otherwise(s))
    found = F.filter(F.regexp_extract_all(F.array_join(marked, "\n"), F.lit(PARAGRAPH), F.lit(0)), lambda p: p.rlike(r"[^\s\x01]"))
    return F.transform(found, lambda p: F.struct((F.length(F.regexp_extract(p, f"^{LEVEL}*", 0))).alias("level"), F.regexp_replace(p, f"(?m)^{LEVEL}+", "").alias("body")))


def link_quotes(messages: DataFrame, thread: str | None, order: str, text: str = "text") -> DataFrame:
    """Find the message that each message answers by what it quotes.

    Adds ``parent`` (``order`` of the original of its first-level quotes, the latest if there are
    several, null without one), ``quoted`` and ``linked`` (quoted passages, and those whose original was found) and
    ``own`` (the text without quotes) to the columns of ``messages``. A passage is a
    paragraph of one quote level; its original is the latest earlier message of the thread, or of all messages if
    ``thread`` is None, with an equal paragraph of its own. White space and case do
    not matter. ``order`` is a whole number, and with the thread the key of a message; rows that share it,
    or have none, are linked alike. Null texts have no passages and a null ``own``. Columns of
    ``messages`` that are named like the added ones give way to them; other names are free. A part of a
    paragraph is another passage: quotes link by whole paragraphs.

    A passage that a great many messages share is no group: its originals are reduced to the
    latest in each block of BLOCK orders before they meet, and blocks are looked through one by one.
    """
    on = [F.col(thread).alias("_t")] if thread else [F.lit(0).alias("_t")]
    base = messages.select(*on, F.col(order).cast("long").alias("_o"), F.explode(_paragraphs(F.col(text))).alias("_p")).select("_t", "_o", F.col("_p.level").alias("_level"), *key_of(F.col("_p.body")))
    base = staged(base.where("_o is not null").groupBy("_t", "h1", "h2", "_o", "_level").agg(F.count(F.lit(1)).alias("_n")), "passages")
    block = F.floor(F.col("_o") / BLOCK).cast("long").alias("_b")
    same = ["_t", "h1", "h2"]
    own = base.where("_level = 0").select(*same, "_o", block)
    quotes = base.where("_level > 0").select(*same, "_o", "_level", "_n", block)
    # the latest original of each block, and of all blocks before it
    per = own.groupBy(*same, "_b").agg(F.max("_o").alias("_last"))
    need = per.unionByName(quotes.select(*same, "_b").distinct().withColumn("_last", F.lit(None).cast("long"))).groupBy(*same, "_b").agg(F.max("_last").alias("_last"))
    before = need.withColumn("_before", F.max("_last").over(Window.partitionBy(*same).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select(*same, "_b", "_before")
    # inside a block: the latest own occurrence before the quote
    both = own.select(*same, "_b", "_o", F.col("_o").alias("_at"), F.lit(0).alias("_level"), F.lit(0).cast("long").alias("_n")).unionByName(quotes.select(*same, "_b", "_o", F.lit(None).cast("long").alias("_at"), "_level", "_n"))
    inside = both.withColumn("_here", F.max("_at").over(Window.partitionBy(*same, "_b").orderBy("_o").rangeBetween(Window.unboundedPreceding, -1))).where("_level > 0")
    # a thread may be null: it is one like any other
    before = before.select(*(F.col(c).alias(c + "2") for c in (*same, "_b")), "_before")
    found = inside.join(before, F.col("_t").eqNullSafe(F.col("_t2")) & (F.col("h1") == F.col("h12")) & (F.col("h2") == F.col("h22")) & (F.col("_b") == F.col("_b2")), "left").select("_t", "_o", "_level", "_n", F.coalesce("_here", "_before").alias("_from"))
    info = found.groupBy("_t", "_o").agg(F.max(F.when(F.col("_level") == 1, F.col("_from"))).alias("parent"), F.sum("_n").alias("quoted"), F.sum(F.when(F.col("_from").isNotNull(), F.col("_n")).otherwise(0)).alias("linked"))
    out = _joined(messages, info, thread, order, ["parent", "quoted", "linked"], drop=["own"])
    return out.withColumns({"quoted": F.coalesce("quoted", F.lit(0)).cast("long"), "linked": F.coalesce("linked", F.lit(0)).cast("long"), "own": own_text(F.col(text))})


def _joined(messages: DataFrame, info: DataFrame, thread: str | None, order: str, columns: list[str], drop: list[str] | None = None) -> DataFrame:
    """``messages`` with columns of ``info`` (_t, _o, ...) by thread and order, in place of such ones of their own."""
    given = {c.lower() for c in (*columns, *(drop or []))}
    left = messages.drop(*(c for c in messages.columns if c.lower() in given))
    t, o = free(left, "t"), free(left, "o")
    right = info.select(F.col("_t").alias(t), F.col("_o").alias(o), *columns)
    key = F.col(thread) if thread else F.lit(0)
    return left.join(right, key.eqNullSafe(F.col(t)) & (F.col(order).cast("long") == F.col(o)), "left").drop(t, o)


def reply_order(linked: DataFrame, thread: str | None, order: str) -> DataFrame:
    """Adds ``root`` and ``depth``: the first message of a chain of replies, and how far it is.

    Parents are earlier than their replies, so (root, depth, order) reads a conversation in reply
    order. Pointers double every round; each round is staged; only messages still on their way take part in it.
    """
    t = F.col(thread) if thread else F.lit(0)
    now = linked.select(t.alias("_t"), F.col(order).cast("long").alias("_o"), F.col("parent").alias("_up")).where("_o is not null").groupBy("_t", "_o").agg(F.max("_up").alias("_up"))
    first = now.select("_t", "_o", F.coalesce("_up", "_o").alias("_up"), F.col("_up").isNotNull().cast("long").alias("_d"), F.col("_up").isNull().alias("_end"))
    first = staged(first, "replies")
    settled, moving = first.where("_end"), first.where("not _end")
    while not moving.isEmpty():  # pointers that have reached a first message are not looked up again
        to = settled.unionByName(moving).select(F.col("_t").alias("_t2"), F.col("_o").alias("_o2"), F.col("_up").alias("_up2"), F.col("_d").alias("_d2"), F.col("_end").alias("_end2"))
        step = moving.join(to, F.col("_t").eqNullSafe(F.col("_t2")) & (F.col("_up") == F.col("_o2")), "left")
        step = staged(step.select("_t", "_o", F.coalesce("_up2", "_up").alias("_up"), (F.col("_d") + F.coalesce("_d2", F.lit(0))).alias("_d"), F.coalesce("_end2", F.lit(True)).alias("_end")), "replies")
        settled, moving = settled.unionByName(step.where("_end")), step.where("not _end")
    named = settled.select("_t", "_o", F.col("_up").alias("root"), F.col("_d").alias("depth"))
    return _joined(linked, named, thread, order, ["root", "depth"])


def chats(ordered: DataFrame, thread: str, order: str, role: str = "role") -> DataFrame:
    """Conversations in reply order: ``thread, root, part, messages``, CHAT_PART messages to a row.

    ``messages`` are structs of ``place, order, role, text, parent, depth, quoted, linked``; ``place`` counts the
    conversation's messages from 0 in the order of (depth, order). Rows that share an order are told apart by
    text and role. Messages without an order belong to no conversation. Places are ranks in blocks of
    BLOCK orders of one depth plus the sizes of the blocks before, so a root with any number of
    replies is no group in a task.
    """
    own = F.col("own")
    rows = ordered.where(F.col("root").isNotNull()).select(
        F.col(thread).alias("_t"), F.col("root").alias("_r"), F.col("depth").alias("_d"), F.floor(F.col(order) / BLOCK).cast("long").alias("_b"),
        F.col(order).cast("long").alias("order"), F.col(role).alias("role"), own.alias("text"), "parent", "quoted", "linked", F.xxhash64(own, role).alias("_h"),
    )
    same = ["_t", "_r", "_d", "_b"]
    sizes = staged(rows.groupBy(*same).agg(F.count(F.lit(1)).alias("_n")), "blocks")
    before = F.sum("_n").over(Window.partitionBy("_t", "_r").orderBy("_d", "_b").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*(F.col(c).alias(c + "2") for c in same), F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*same).orderBy("order", "_h")) - 1)
    placed = ranked.join(sizes, F.col("_t").eqNullSafe(F.col("_t2")) & (F.col("_r") == F.col("_r2")) & (F.col("_d") == F.col("_d2")) & (F.col("_b") == F.col("_b2")))
    placed = placed.withColumn("place", F.col("_before") + F.col("_k"))
    item = F.struct("place", "order", "role", "text", "parent", F.col("_d").alias("depth"), "quoted", "linked")
    parts = placed.groupBy("_t", "_r", F.floor(F.col("place") / CHAT_PART).alias("part")).agg(F.array_sort(F.collect_list(item)).alias("messages"))
    return parts.select(F.col("_t").alias(thread), F.col("_r").alias("root"), "part", "messages")


def as_mail(turns: DataFrame) -> DataFrame:
    """Conversations the way a mail archive holds them.

    A turn answers the one before it, every third by number the one before that, so that threads branch,
    and some turns quote nothing. A mail quotes what it answers, and what that one answered at a second level.
    """
    base = turns.select("conv_id", "turn", "role", "text", _answers(F.col("conv_id"), F.col("turn")).alias("_p1"))
    base = base.withColumn("_p2", _answers(F.col("conv_id"), F.col("_p1")))
    out = base
    for k in (1, 2):
        there = turns.select(F.col("conv_id").alias(f"_c{k}"), F.col("turn").alias(f"_u{k}"), F.col("text").alias(f"_q{k}")).dropDuplicates([f"_c{k}", f"_u{k}"])
        out = out.join(there, (F.col("conv_id") == F.col(f"_c{k}")) & (F.col(f"_p{k}") == F.col(f"_u{k}")), "left")
    quote = lambda c, mark: F.when(c.isNotNull(), F.concat(F.lit(mark), F.replace(c, F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))).otherwise("")
    body = F.concat(quote(F.when(F.col("_q1").isNotNull(), F.col("_q2")), ">> "), quote(F.col("_q1"), "> "), F.when(F.col("_q1").isNotNull(), "\n").otherwise(""), F.coalesce("text", F.lit("")))
    return out.select("conv_id", "turn", "role", body.alias("text"))


def _answers(conv: Column, turn: Column) -> Column:
    """The turn that a turn answers; null if it quotes nothing."""
    return F.when((7 * conv + turn) % 11 != 5, turn - F.when((conv + turn) % 3 == 0, 2).otherwise(1))


def op4_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as quoting mail, linked again and built anew: one row per message, with its
    place in the conversation that ``chats`` gives."""
    mail = staged(as_mail(table(spark, sf_dir, "conversations")), "mail")
    built = chats(reply_order(link_quotes(mail, "conv_id", "turn"), "conv_id", "turn"), "conv_id", "turn")
    m = built.select("conv_id", "root", F.explode("messages").alias("m"))
    return m.select("conv_id", F.col("m.order").alias("turn"), "m.role", F.col("m.parent").alias("parent_turn"), F.col("root").alias("root_turn"), "m.depth", "m.place", "m.quoted", "m.linked", F.sha2(F.col("m.text").cast("binary"), 256).alias("text_sha256"))


OP4_SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text,
         list_filter(regexp_split_to_array(text, '\n(?:[ \t\r]*\n)+'), lambda p: regexp_matches(p, '\S')) AS ps,
         CASE WHEN (7 * conv_id + turn) % 11 <> 5 THEN turn - CASE WHEN (conv_id + turn) % 3 = 0 THEN 2 ELSE 1 END END AS p1
  FROM conversations),
own AS (SELECT DISTINCT conv_id, turn, lower(trim(regexp_replace(unnest(ps), '\s+', ' ', 'g'))) AS p FROM m),
q AS (
  SELECT m.conv_id, m.turn, 1 AS level, unnest(a.ps) AS p FROM m JOIN m a ON a.conv_id = m.conv_id AND a.turn = m.p1
  UNION ALL
  SELECT m.conv_id, m.turn, 2, unnest(b.ps) FROM m JOIN m a ON a.conv_id = m.conv_id AND a.turn = m.p1 JOIN m b ON b.conv_id = m.conv_id AND b.turn = a.p1),
f AS (
  SELECT q.conv_id, q.turn, q.level, q.p, max(own.turn) AS origin
  FROM (SELECT *, row_number() OVER () AS k FROM (SELECT conv_id, turn, level, lower(trim(regexp_replace(p, '\s+', ' ', 'g'))) AS p FROM q)) q
  LEFT JOIN own ON own.conv_id = q.conv_id AND own.p = q.p AND own.turn < q.turn GROUP BY q.conv_id, q.turn, q.level, q.p, q.k),
i AS (SELECT conv_id, turn, max(CASE WHEN level = 1 THEN origin END) AS parent_turn, count(*) AS quoted, count(origin) AS linked FROM f GROUP BY ALL),
l AS (SELECT m.conv_id, m.turn, role, text, parent_turn, coalesce(quoted, 0) AS quoted, coalesce(linked, 0) AS linked FROM m LEFT JOIN i USING (conv_id, turn)),
r AS (
  SELECT conv_id, turn, turn AS root_turn, CAST(0 AS BIGINT) AS depth FROM l WHERE parent_turn IS NULL
  UNION ALL
  SELECT l.conv_id, l.turn, r.root_turn, r.depth + 1 FROM l JOIN r ON l.conv_id = r.conv_id AND l.parent_turn = r.turn)
SELECT conv_id, turn, role, parent_turn, root_turn, depth, row_number() OVER (PARTITION BY conv_id, root_turn ORDER BY depth, turn) - 1 AS place,
       quoted, linked, sha256(text) AS text_sha256
FROM l JOIN r USING (conv_id, turn)
"""
