"""Quotations in messages linked to the messages they quote, and conversations in reply order without quotes.

Lines that begin with `>` marks are quoted, one level for each mark; a stretch of lines of one level is a
passage. Each passage is normalised (lower case, single spaces) and hashed. A message can be quoted whole, by
one of its unquoted stretches or by unquoted lines that follow each other (blank ones aside), so these are
hashed too, and per conversation and hash the first message that holds it is the original. Of runs of several
lines only those are hashed that begin with the first line of a passage of as many lines. A passage is linked with the original if that came earlier.
A message replies to the latest message that it quotes at the first level, which comes before it; so turns
order each thread with replies after what they answer. Roots and depths follow from doubling pointers.

Only DataFrame functions are used. One row per conversation and hash is joined, so equal messages or quotes in
a conversation never multiply, and joins on hot keys can be split by adaptive execution.

A message is named by conv_id, turn and `message`, the MD5 of its text, so different texts of one turn (siblings) are
messages of their own; of holders in the same earliest turn the one with the smallest `message` is the original.

Defined results: null text is empty; rows that repeat conv_id, turn and text count once, with the smallest role; rows
with null conv_id or turn are returned as roots without links; a passage without a word is no quotation; columns
other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlab.llm import common

_MARKS = r"^[ \t]*((?:>[ \t]?)*)"


def _digest(text: Column | str) -> Column:
    return F.unhex(F.md5(text))


def _shown(digest: str) -> Column:
    return F.lower(F.hex(digest))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def with_passages(rows: DataFrame, text: str = "text") -> DataFrame:
    """`rows` with `passages`, an array of (level, body): stretches of lines of one quote level, without their marks.

    Lines and the places where a stretch starts are columns of their own, each used more than once by the next, which
    keeps the optimiser from writing one into the other. So a text's lines are made once, not once for each line.
    """
    lines, starts = F.col("_lines"), F.col("_starts")
    split = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), r"[ \t]", "")).alias("level"),
            F.when(F.rlike(line, F.lit(r"^[ \t]*>")), F.regexp_replace(line, _MARKS, "")).otherwise(line).alias("body"),
        ),
    )
    changes = F.filter(
        F.sequence(F.lit(1), F.size(lines)),
        lambda i: (i == 1) | (F.element_at(lines, i)["level"] != F.element_at(lines, F.greatest(i - 1, F.lit(1)))["level"]),
    )
    stretches = F.transform(
        starts,
        lambda start, k: F.struct(
            F.element_at(lines, start)["level"].alias("level"),
            F.array_join(
                F.transform(F.slice(lines, start, F.coalesce(F.get(starts, k + 1), F.size(lines) + 1) - start), lambda x: x["body"]),
                "\n",
            ).alias("body"),
        ),
    )
    return (
        rows.withColumn("_lines", split).withColumn("_starts", changes).withColumn("passages", stretches).drop("_lines", "_starts")
    )


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, place (turn, message), role, passages, body (unquoted text), n_quotes."""
    read = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    one = read.groupBy("conv_id", "turn", "text").agg(F.min("role").alias("role"))
    named = one.select("conv_id", F.struct("turn", _digest("text").alias("message")).alias("place"), "role", "text")
    own = F.filter("passages", lambda p: p["level"] == 0)
    body = F.trim(F.array_join(F.transform(own, lambda p: p["body"]), "\n"), F.lit(" \n\t\r"))
    quoted = F.filter("passages", lambda p: (p["level"] > 0) & (normalised(p["body"]) != ""))
    split = with_passages(named).withColumn("body", body).withColumn("n_quotes", F.size(quoted).cast("long"))
    return split.drop("text")


def _lines(text: Column) -> Column:
    """The normalised lines of a text that aren't blank."""
    return F.filter(F.transform(F.split(text, "\n"), normalised), lambda line: line != "")


def _runs(parsed_messages: DataFrame) -> DataFrame:
    """conv_id, place, text: runs of several unquoted lines that a passage of the conversation may quote."""
    quoted = parsed_messages.select("conv_id", F.explode("passages").alias("p")).where("p.level > 0")
    quoted = quoted.select("conv_id", _lines(F.col("p.body")).alias("lines")).where("size(lines) > 1")
    wanted = quoted.groupBy("conv_id", _digest(F.col("lines")[0]).alias("first")).agg(
        F.collect_set(F.size("lines")).alias("lengths")
    )
    held = parsed_messages.select("conv_id", "place", _lines(F.col("body")).alias("lines")).where("size(lines) > 1")
    starts = held.select("conv_id", "place", F.posexplode("lines").alias("at", "line"), F.size("lines").alias("n"))
    starts = starts.select("conv_id", "place", "at", "n", _digest("line").alias("first")).join(wanted, ["conv_id", "first"])
    starts = starts.select("conv_id", "place", "at", "n", F.explode("lengths").alias("length")).where("at + length <= n")
    text = F.array_join(F.slice("lines", F.col("at") + 1, F.col("length")), " ")
    return starts.join(held, ["conv_id", "place"]).select("conv_id", "place", text.alias("text"))


def originals(parsed_messages: DataFrame) -> DataFrame:
    """conv_id, hash, original: the place of the first message that holds a text, stretch or run of lines."""
    own = F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["body"])
    lines = F.split("body", "\n")
    texts = F.array_distinct(F.transform(F.flatten(F.array(F.array("body"), own, lines)), normalised))
    rows = parsed_messages.select("conv_id", "place", F.explode(texts).alias("text")).where("text <> ''")
    rows = rows.union(_runs(parsed_messages))
    return rows.groupBy("conv_id", _digest("text").alias("hash")).agg(F.min("place").alias("original"))


def quotations(parsed_messages: DataFrame) -> DataFrame:
    """conv_id, place, passage (from 1), level, hash, original (null if no message of an earlier turn holds it)."""
    rows = parsed_messages.select("conv_id", "place", F.posexplode("passages").alias("at", "p")).where("p.level > 0")
    rows = rows.select(
        "conv_id", "place", (F.col("at") + 1).alias("passage"), F.col("p.level").alias("level"), normalised(F.col("p.body")).alias("text")
    ).where("text <> ''")
    rows = rows.withColumn("hash", _digest("text")).drop("text")
    found = rows.join(originals(parsed_messages), ["conv_id", "hash"], "left")
    earlier = F.when(F.col("original.turn") < F.col("place.turn"), F.col("original"))
    return found.select("conv_id", "place", "passage", "level", "hash", earlier.alias("original"))


def reply_ordered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, message, role, body, parent_turn, parent_message, root_turn, root_message, depth, n_quotes, n_linked.

    Sorting by conv_id, root_turn, root_message, turn and message gives the threads of a conversation in reply order.
    """
    parts = common.saved(parsed(messages))
    in_order = "conv_id is not null and place.turn is not null"
    parts, loose = parts.where(in_order), parts.where(f"not ({in_order})")
    quotes = quotations(parts).groupBy("conv_id", "place").agg(
        F.count("original").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("original"))).alias("parent")
    )
    linked = parts.select("conv_id", "place", "role", "body", "n_quotes").join(quotes, ["conv_id", "place"], "left")
    linked = common.saved(linked)
    # `up` is an ancestor 'depth' steps above; each round jumps from it to its own ancestor.
    climbing = common.saved(
        linked.select(
            "conv_id", "place", F.coalesce("parent", "place").alias("up"),
            F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        )
    )
    while True:
        above = climbing.select("conv_id", F.col("place").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        next_ = common.saved(
            climbing.join(above, ["conv_id", "up"]).select(
                "conv_id", "place", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth")
            )
        )
        moved = next_.agg(F.sum("depth")).first()[0] != climbing.agg(F.sum("depth")).first()[0]
        climbing = next_
        if not moved:
            break
    placed = linked.join(climbing, ["conv_id", "place"])
    alone = loose.withColumns({"parent": F.lit(None).cast(placed.schema["parent"].dataType), "up": F.col("place")})
    alone = alone.withColumns({"depth": F.lit(0).cast("long"), "n_linked": F.lit(0).cast("long")}).drop("passages")
    return placed.unionByName(alone).select(
        "conv_id", "place.turn", _shown("place.message").alias("message"), "role", "body", F.col("parent.turn").alias("parent_turn"),
        _shown("parent.message").alias("parent_message"), F.col("up.turn").alias("root_turn"),
        _shown("up.message").alias("root_message"), "depth", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )


def quoting_messages(conversations: DataFrame) -> DataFrame:
    """Messages with quotations derived from every row of the conversations table.

    Three of four turns quote the turn before them, and every third of these also quotes, one level deeper, the
    turn before that. Of the turn before, a fifth of quotations is of the first line, a fifth of the second and
    third, a fifth of all lines but the first and the last, and the others are of the whole text.
    """
    texts = conversations.groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    before = texts.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("one"))
    before2 = texts.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("two"))
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(before, ["conv_id", "turn"], "left").join(before2, ["conv_id", "turn"], "left")
    place = F.col("conv_id") * 7 + F.col("turn")
    lines = F.split("one", "\n")
    one = (
        F.when(place % 5 == 0, F.substring_index("one", "\n", 1))
        .when(place % 5 == 1, F.array_join(F.slice(lines, 2, 2), "\n"))
        .when(place % 5 == 2, F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n"))
        .otherwise(F.col("one"))
    )
    quoted = F.when(place % 4 != 0, F.concat(F.lit("> "), F.regexp_replace(one, "\n", "\n> "), F.lit("\n")))
    deeper = F.when(
        (place % 4 != 0) & (place % 3 == 0), F.concat(F.lit(">> "), F.regexp_replace("two", "\n", "\n>> "), F.lit("\n"))
    )
    text = F.concat(F.coalesce(deeper, F.lit("")), F.coalesce(quoted, F.lit("")), F.col("text"))
    return rows.select("conv_id", "turn", "role", text.alias("text"))


def reply_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query over all conversations."""
    return reply_ordered(quoting_messages(common.table(spark, sf_dir, "conversations")))


SQL = r"""
WITH RECURSIVE texts AS (
  SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations GROUP BY conv_id, turn
), sources AS (
  SELECT t.conv_id, t.turn, t.role, coalesce(t.text, '') AS text, a.text AS one, b.text AS two,
    t.conv_id * 7 + t.turn AS place, string_split(a.text, chr(10)) AS ls
  FROM conversations AS t
  LEFT JOIN texts AS a ON a.conv_id = t.conv_id AND a.turn = t.turn - 1
  LEFT JOIN texts AS b ON b.conv_id = t.conv_id AND b.turn = t.turn - 2
), chosen AS (
  SELECT *, CASE WHEN one IS NULL THEN NULL ELSE CASE place % 5 WHEN 0 THEN ls[1]
    WHEN 1 THEN coalesce(array_to_string(ls[2:3], chr(10)), '')
    WHEN 2 THEN coalesce(array_to_string(ls[2:len(ls) - 1], chr(10)), '') ELSE one END END AS part
  FROM sources
), messages AS (
  SELECT conv_id, turn, min(role) AS role, text, md5(text) AS message FROM (
    SELECT conv_id, turn, role,
      coalesce(CASE WHEN place % 4 <> 0 AND place % 3 = 0 THEN '>> ' || replace(two, chr(10), chr(10) || '>> ') || chr(10) END, '')
      || coalesce(CASE WHEN place % 4 <> 0 THEN '> ' || replace(part, chr(10), chr(10) || '> ') || chr(10) END, '')
      || text AS text
    FROM chosen
  ) AS m GROUP BY conv_id, turn, text
), lines AS (
  SELECT conv_id, turn, message, role, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM messages
), levels AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]?)*)', 1), '[ \t]', '', 'g')) AS level,
    CASE WHEN regexp_matches(line, '^[ \t]*>') THEN regexp_replace(line, '^[ \t]*((?:>[ \t]?)*)', '') ELSE line END AS body
  FROM lines
), changes AS (
  SELECT *, CASE WHEN lag(level) OVER w IS DISTINCT FROM level THEN 1 ELSE 0 END AS change
  FROM levels WINDOW w AS (PARTITION BY conv_id, turn, message ORDER BY i)
), runs AS (
  SELECT *, sum(change) OVER (PARTITION BY conv_id, turn, message ORDER BY i) AS passage FROM changes
), stretches AS (
  SELECT conv_id, turn, message, passage, level, string_agg(body, chr(10) ORDER BY i) AS body
  FROM runs GROUP BY conv_id, turn, message, passage, level
), bodies AS (
  SELECT conv_id, turn, message, min(role) AS role,
    trim(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0), ''), chr(10) || chr(9) || chr(13) || ' ') AS body
  FROM runs GROUP BY conv_id, turn, message
), line_lists AS (
  SELECT conv_id, turn, message, level, list_filter(list_transform(string_split(body, chr(10)),
    lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))), lambda x: x <> '') AS ls
  FROM (SELECT conv_id, turn, message, 0 AS level, body FROM bodies
    UNION ALL SELECT conv_id, turn, message, level, body FROM stretches WHERE level > 0) AS l
), wanted AS (
  SELECT DISTINCT conv_id, ls[1] AS first, len(ls) AS n FROM line_lists WHERE level > 0 AND len(ls) > 1
), starts AS (
  SELECT conv_id, turn, message, ls, unnest(range(1, len(ls) + 1)) AS at FROM line_lists WHERE level = 0 AND len(ls) > 1
), held AS (
  SELECT conv_id, turn, message, body FROM bodies
  UNION ALL SELECT conv_id, turn, message, body FROM stretches WHERE level = 0
  UNION ALL SELECT conv_id, turn, message, unnest(string_split(body, chr(10))) FROM bodies
  UNION ALL SELECT s.conv_id, s.turn, s.message, array_to_string(s.ls[s.at:s.at + w.n - 1], ' ')
  FROM starts AS s JOIN wanted AS w ON w.conv_id = s.conv_id AND w.first = s.ls[s.at] AND s.at + w.n - 1 <= len(s.ls)
), originals AS (
  SELECT conv_id, text, min({'turn': turn, 'message': message}) AS o
  FROM (SELECT *, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) AS text FROM held) AS n
  WHERE text <> '' GROUP BY conv_id, text
), quotes AS (
  SELECT s.conv_id, s.turn, s.message, s.level, CASE WHEN o.o.turn < s.turn THEN o.o END AS original
  FROM (
    SELECT *, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) AS text FROM stretches WHERE level > 0
  ) AS s LEFT JOIN originals AS o ON o.conv_id = s.conv_id AND o.text = s.text
  WHERE s.text <> ''
), counted AS (
  SELECT conv_id, turn, message, count(*) AS n_quotes, count(original) AS n_linked,
    max(CASE WHEN level = 1 THEN original END) AS parent
  FROM quotes GROUP BY conv_id, turn, message
), linked AS (
  SELECT b.*, c.parent, coalesce(c.n_quotes, 0) AS n_quotes, coalesce(c.n_linked, 0) AS n_linked
  FROM bodies AS b LEFT JOIN counted AS c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
    AND c.turn IS NOT DISTINCT FROM b.turn AND c.message = b.message
), threads AS (
  SELECT conv_id, turn, message, turn AS root_turn, message AS root_message, CAST(0 AS BIGINT) AS depth
  FROM linked WHERE parent IS NULL
  UNION ALL
  SELECT l.conv_id, l.turn, l.message, t.root_turn, t.root_message, t.depth + 1 FROM linked AS l JOIN threads AS t
    ON t.conv_id = l.conv_id AND t.turn = l.parent.turn AND t.message = l.parent.message
)
SELECT l.conv_id, l.turn, l.message, l.role, l.body, l.parent.turn AS parent_turn, l.parent.message AS parent_message,
  t.root_turn, t.root_message, t.depth, l.n_quotes, l.n_linked
FROM linked AS l JOIN threads AS t ON t.conv_id IS NOT DISTINCT FROM l.conv_id
  AND t.turn IS NOT DISTINCT FROM l.turn AND t.message = l.message
"""
