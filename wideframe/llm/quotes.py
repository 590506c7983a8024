"""Operator 10 - chat formatting by quotation linking.

Messages quote earlier ones with ``>`` line by line, nested quotes with ``>>``
and so on.  Quoted lines are parsed into levels and normalised (lower case, white
space runs to one blank, trimmed); adjacent lines of one level are one passage.
A passage is hashed line by line and, its lines folded into one, by windows of
``WINDOW`` words (a shorter passage is one window), so that quotes that are wrapped
anew or take part of a line are found.  Of the earlier messages of the conversation
that wrote a line of the passage or half of its words, it is linked to the one that
covers most of its words, then has most of its windows, then the shortest, then the latest;
equal messages count as their first.  A message replies to the message of its
outermost linked passages (of several, the latest), and without a link to the
message before it.  A message that is its parent's first reply
carries on the parent's branch, any other opens a branch.  Each message comes out
with its place in its branch and without quotes and their ``On ... wrote:`` lines.

All of it is DataFrame expressions.

Scale: no window or group holds a whole conversation.  Places within a
conversation are counted in levels (parts of a turn, turns, runs of ``SPAN`` turns, then the runs),
hashes are matched by conversation between distinct passages and distinct messages,
and a passage's best message so far is a running maximum in two levels, so a message
that is written and quoted often costs its own rows only.  A hash that many distinct
messages of a conversation hold meets each distinct passage that holds it.  Adjacent messages of a branch are one run, and only runs that follow a
quotation link are chained, by pointer jumping with checkpoints.

Edge cases: a null text is empty; a null turn comes first, null roles first among
equal turns, then texts by their MD5.  Very long texts, with any number of quoted
lines or quote marks, take time linear in their length.  Messages with a null conversation are
single: place 0 of their own branch, no parent.  A quoted line found in no
earlier message is dropped from the text and links nothing.  Blank quoted lines
link nothing.  Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._text import fresh_path, shared_dir

#: Turns in a run of the two-level count.
SPAN = 512
#: Words of a window.
WINDOW = 4

_LINKS = "array<struct<level:int,source_seq:bigint>>"

_BLANKS = " \t\n\x0b\f\r"


def own_text(text: Column) -> Column:
    """A message without its quoted lines and their introductions."""
    # one match a line, without repeated groups, which would recurse once for each repetition
    gone = r"(?md)^On [^\n]*wrote:[ \t]*\n(?=[ \t]*>)|^[ \t]*>[^\n]*(?:\n|\z)"
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), gone, ""), F.lit(_BLANKS))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[ \t\n\x0B\f\r]+", " "))


def quoted_lines(text: Column) -> Column:
    """Array of (at, level, line) of a message's quoted lines, ``at`` their place among all its lines."""
    # a mark ends with a line's last > before anything but blanks
    marks = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), F.rtrim(F.regexp_extract(x, r"^[ \t>]*", 0), F.lit(" \t")).alias("m"), x.alias("x")))
    return F.transform(
        F.filter(marks, lambda s: s["m"] != ""),
        lambda s: F.struct(s["at"].alias("at"), (F.char_length(s["m"]) - F.char_length(F.replace(s["m"], F.lit(">"), F.lit("")))).alias("level"), normalised(F.substring(s["x"], F.char_length(s["m"]) + 1, F.char_length(s["x"]))).alias("line")),
    )


def _carried(rows: DataFrame, run: str, value: Column, name: str, how) -> DataFrame:
    """Adds ``how`` of ``value`` over the earlier runs of the conversation."""
    parts = rows.groupBy("conv_id", run).agg(how(value).alias("_v"))
    before = Window.partitionBy("conv_id").orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", run, how(F.col("_v")).over(before).alias(name))
    return rows.join(parts, ["conv_id", run])


def _numbered(messages: DataFrame) -> DataFrame:
    """Messages of known conversations with ``seq``, their place by turn, then role, then MD5 of the text.

    Rows of one turn are counted by role and the first byte of the MD5, equal
    rows as one row with a number, so no window holds all rows of a turn.
    """
    zero = F.lit(0).cast("bigint")
    rows = messages.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.md5("text")).withColumn("part", F.substring("h", 1, 2))
    # codes without nulls, for joins: the turn as it is sorted, the role likewise
    rows = rows.withColumn("at", F.concat(F.when(F.col("turn").isNull(), "").otherwise("t"), F.coalesce(F.col("turn").cast("string"), F.lit(""))))
    rows = rows.withColumn("by", F.concat(F.when(F.col("role").isNull(), "").otherwise("r"), F.coalesce("role", F.lit("")))).withColumn("run", F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(1 << 62))))
    sofar = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    own = ["conv_id", "at", "by", "part"]
    parts = rows.groupBy(*own, "turn", "run").agg(F.sum("n").alias("n"))
    turns = parts.groupBy("conv_id", "at", "turn", "run").agg(F.sum("n").alias("n"))
    runs = turns.groupBy("conv_id", "run").agg(F.sum("n").alias("n"))
    runs = runs.select("conv_id", "run", F.coalesce(F.sum("n").over(sofar(Window.partitionBy("conv_id").orderBy("run"))), zero).alias("before_run"))
    turns = turns.join(runs, ["conv_id", "run"])
    turns = turns.select("conv_id", "at", (F.col("before_run") + F.coalesce(F.sum("n").over(sofar(Window.partitionBy("conv_id", "run").orderBy(F.asc_nulls_first("turn")))), zero)).alias("before_turn"))
    parts = parts.select(*own, F.coalesce(F.sum("n").over(sofar(Window.partitionBy("conv_id", "at").orderBy("by", "part"))), zero).alias("before_part"))
    places = parts.join(turns, ["conv_id", "at"]).select(*own, (F.col("before_turn") + F.col("before_part")).alias("before"))
    rows = rows.withColumn("inside", F.coalesce(F.sum("n").over(sofar(Window.partitionBy(*own).orderBy("h"))), zero)).join(places, own)
    first = F.col("before") + F.col("inside")
    rows = rows.select("conv_id", "turn", "role", "text", "n", first.alias("first"), F.explode(F.sequence(zero, F.floor((F.col("n") - 1) / SPAN))).alias("block"))
    copies = F.sequence(F.col("block") * SPAN, F.least(F.col("n"), (F.col("block") + 1) * SPAN) - 1)
    return rows.select("conv_id", "turn", "role", "text", "first", F.explode(copies).alias("copy")).select("conv_id", "turn", "role", "text", (F.col("first") + F.col("copy")).alias("seq"))


def _windows(words: Column, size: Column) -> Column:
    """Array of (hash, start) of the windows of ``size`` words, at least 1."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.md5(F.concat_ws(" ", F.lit("w"), F.slice(words, i, size))).alias("hash"), i.alias("start")))


def _line_hash(line: Column) -> Column:
    return F.md5(F.concat(F.lit("l "), line))


def _passages(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, level, passage, lines) of the runs of adjacent quoted lines of one level; ``passage`` is unique to a conversation."""
    said = messages.select("conv_id", "seq", F.explode("quoted").alias("q")).select("conv_id", "seq", "q.*")
    order = Window.partitionBy("conv_id", "seq").orderBy("at")
    starts = F.coalesce((F.lag("at").over(order) != F.col("at") - 1) | (F.lag("level").over(order) != F.col("level")), F.lit(True))
    runs = said.withColumn("starts", starts.cast("int")).withColumn("run", F.sum("starts").over(order)).where("line <> ''")
    runs = runs.groupBy("conv_id", "seq", "run", "level").agg(F.sort_array(F.collect_list(F.struct("at", "line")))["line"].alias("lines"))
    return runs.select("conv_id", "seq", "level", F.md5(F.concat_ws("\n", F.col("conv_id").cast("string"), "lines")).alias("passage"), "lines")


def _linked(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, linked, links) of the messages with a linked passage."""
    spark = messages.sparkSession
    path = fresh_path(spark, "passages")
    _passages(messages.where(F.size("quoted") > 0)).write.parquet(path)
    quoting = spark.read.parquet(path)
    texts = quoting.dropDuplicates(["passage"]).select("conv_id", "passage", "lines", F.split(F.concat_ws(" ", "lines"), " ").alias("words"))
    texts = texts.withColumn("n", F.size("words")).withColumn("size", F.least("n", F.lit(WINDOW)))
    windows = texts.select("conv_id", "passage", "n", "size", F.explode(_windows(F.col("words"), F.col("size"))).alias("w"))
    windows = windows.select("conv_id", "passage", "n", "w.hash", F.col("w.start").alias("start"), "size", F.lit(False).alias("whole"))
    lines = texts.select("conv_id", "passage", "n", F.posexplode("lines").alias("k", "line")).withColumn("size", F.size(F.split("line", " ")))
    ahead = F.sum("size").over(Window.partitionBy("passage").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.select("conv_id", "passage", "n", _line_hash(F.col("line")).alias("hash"), (F.coalesce(ahead, F.lit(0)) + 1).cast("int").alias("start"), "size", F.lit(True).alias("whole"))
    units = windows.union(lines)

    wrote = messages.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "seq", F.split("text", "\n").alias("lines"), normalised(F.col("text")).alias("folded"))
    wrote = wrote.groupBy("conv_id", F.md5(F.concat_ws("\n", F.transform("lines", normalised))).alias("same")).agg(F.min_by(F.struct("seq", "lines", "folded"), "seq").alias("m")).select("conv_id", "m.*")
    wrote = wrote.where("folded <> ''").withColumn("words", F.split("folded", " "))
    hashes = F.concat(F.transform("lines", lambda x: _line_hash(normalised(x))), *[F.transform(_windows(F.col("words"), F.lit(k)), lambda w: w["hash"]) for k in range(1, WINDOW + 1)])
    held = wrote.select("conv_id", F.col("seq").alias("source"), F.size("words").alias("n_source"), F.explode(F.array_distinct(hashes)).alias("hash"))

    covers = units.join(held, ["conv_id", "hash"]).groupBy("conv_id", "passage", "n", "source", "n_source").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("size") - 1))))).alias("cover"), F.count(F.lit(1)).alias("units"), F.max("whole").alias("whole")
    )
    covers = covers.where("whole or 2 * cover >= n")
    value = F.struct("cover", "units", (-F.col("n_source")).alias("short"), "source")
    # the best earlier message of each quoting one: a running maximum by passage
    rows = covers.select(F.col("passage").alias("conv_id"), F.col("source").alias("seq"), value.alias("best"), F.lit(None).cast("bigint").alias("talk"), F.lit(None).cast("int").alias("level"))
    asked = quoting.join(covers.select("passage").distinct(), "passage", "left_semi")
    rows = rows.union(asked.select("passage", "seq", F.lit(None).cast(rows.schema["best"].dataType), F.col("conv_id"), "level"))
    rows = _carried(rows.withColumn("run", F.floor(F.col("seq") / SPAN)), "run", F.col("best"), "carried", F.max)
    before = Window.partitionBy("conv_id", "run").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("now", F.max("best").over(before)).withColumn("now", F.greatest("now", "carried"))
    found = rows.where("level is not null and now is not null").select(F.col("talk").alias("conv_id"), "seq", "level", F.col("now.source").alias("source"))
    outermost, every = F.min(F.struct("level", (-F.col("source")).alias("back"))), F.sort_array(F.collect_set(F.struct("level", F.col("source").alias("source_seq"))))
    return found.groupBy("conv_id", "seq").agg(outermost.alias("p"), every.alias("links")).select("conv_id", "seq", (-F.col("p.back")).alias("linked"), "links")


def _chained(runs: DataFrame) -> DataFrame:
    """(conv_id, head, branch, ahead) of runs (conv_id, head, length, prev): first run of the branch, messages before the run."""
    shared_dir(runs.sparkSession)
    now = runs.select("conv_id", "head", F.coalesce("prev", "head").alias("branch"), F.coalesce("prev_length", F.lit(0)).alias("ahead")).checkpoint()
    while True:
        far = now.select("conv_id", F.col("head").alias("branch"), F.col("branch").alias("to"), F.col("ahead").alias("more"))
        step = now.join(far, ["conv_id", "branch"]).select("conv_id", "head", "branch", "to", (F.col("ahead") + F.when(F.col("to") == F.col("branch"), 0).otherwise(F.col("more"))).alias("ahead")).checkpoint()
        now = step.select("conv_id", "head", F.col("to").alias("branch"), "ahead")
        if not step.where("to <> branch").limit(1).count():
            return now


def link_quotations(conversations: DataFrame) -> DataFrame:
    """Reply-ordered messages: conv_id, seq, turn, role, text, n_quoted, parent_seq, parent_turn, branch, position, links.

    ``seq`` is a message's place in its conversation by turn, ``branch`` the seq
    of the first message of its branch, ``position`` its place in the branch.
    ``links`` has (level, source_seq) of the quoted passages of every level, distinct.
    """
    spark = conversations.sparkSession
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    path = fresh_path(spark, "messages")
    numbered = _numbered(rows.where("conv_id is not null"))
    numbered.select("conv_id", "seq", "turn", "role", own_text(F.col("text")).alias("text"), quoted_lines(F.col("text")).alias("quoted")).write.parquet(path)
    messages = spark.read.parquet(path)

    parents = _linked(messages)
    path = fresh_path(spark, "replies")
    ids = messages.select("conv_id", "seq", "turn").join(parents, ["conv_id", "seq"], "left")
    ids = ids.withColumn("parent_seq", F.coalesce("linked", F.when(F.col("seq") > 0, F.col("seq") - 1))).drop("linked").withColumn("links", F.coalesce("links", F.array().cast(_LINKS)))
    replies = ids.where("parent_seq is not null").groupBy("conv_id", "parent_seq").agg(F.min("seq").alias("first_reply"))
    ids = ids.join(replies, ["conv_id", "parent_seq"], "left")
    on = F.coalesce(F.col("seq") == F.col("first_reply"), F.lit(False))
    ids = ids.withColumn("on", on).withColumn("opens", ~(F.col("on") & (F.col("parent_seq") == F.col("seq") - 1)))
    ids = ids.withColumn("run", F.floor(F.col("seq") / SPAN))
    mark = F.when(F.col("opens"), F.col("seq"))
    ids = _carried(ids, "run", mark, "carried", F.max)
    sofar = Window.partitionBy("conv_id", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ids.select("conv_id", "seq", "turn", "parent_seq", "on", "opens", "links", F.coalesce(F.max(mark).over(sofar), "carried").alias("head")).write.parquet(path)
    ids = spark.read.parquet(path)

    length = ids.groupBy("conv_id", "head").agg(F.count(F.lit(1)).alias("length"))
    parent = ids.select("conv_id", F.col("seq").alias("parent_seq"), F.col("turn").alias("parent_turn"), F.col("head").alias("parent_head"))
    ids = ids.join(parent, ["conv_id", "parent_seq"], "left")
    heads = ids.where("opens").select("conv_id", "head", F.when(F.col("on"), F.col("parent_head")).alias("prev"))
    before = length.select("conv_id", F.col("head").alias("prev"), F.col("length").alias("prev_length"))
    chained = _chained(heads.join(before, ["conv_id", "prev"], "left"))
    placed = ids.join(chained, ["conv_id", "head"]).select("conv_id", "seq", "parent_seq", "parent_turn", "branch", "links", (F.col("ahead") + F.col("seq") - F.col("head")).alias("position"))
    out = messages.select("conv_id", "seq", "turn", "role", "text", F.size("quoted").cast("bigint").alias("n_quoted")).join(placed, ["conv_id", "seq"])
    null = F.lit(None).cast("bigint")
    lone = rows.where("conv_id is null").select("conv_id", F.lit(0).cast("bigint").alias("seq"), "turn", "role", own_text(F.col("text")).alias("text"), F.size(quoted_lines(F.col("text"))).cast("bigint").alias("n_quoted"), null.alias("parent_seq"), null.alias("parent_turn"), F.lit(0).cast("bigint").alias("branch"), F.lit(0).cast("bigint").alias("position"), F.array().cast(_LINKS).alias("links"))
    names = ["conv_id", "seq", "turn", "role", "text", "n_quoted", "parent_seq", "parent_turn", "branch", "position", "links"]
    return out.select(*names).unionByName(lone.select(*names))


def op10_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply-ordered messages of every conversation, without quotes; ``links`` as text, ``level:source_seq`` joined by commas."""
    made = link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return made.withColumn("links", F.array_join(F.transform("links", lambda x: F.concat_ws(":", x["level"].cast("string"), x["source_seq"].cast("string"))), ","))


_NORMAL = "trim(regexp_replace(lower({}), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"

#: The query in DuckDB's SQL: units of passages and messages joined as texts, branches by recursion.
ORACLE_SQL = f"""
WITH RECURSIVE messages AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text, conv_id IS NULL AS lone,
        CASE WHEN conv_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(coalesce(text, ''))) - 1 END AS seq,
        row_number() OVER () AS id FROM conversations),
lines AS (SELECT id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM messages),
marks AS (SELECT *, rtrim(regexp_extract(x, '^[ \\t>]*'), ' ' || chr(9)) AS m FROM lines),
flags AS (SELECT *, m <> '' OR (starts_with(x, 'On ') AND ends_with(rtrim(x, ' ' || chr(9)), 'wrote:') AND coalesce(lead(m) OVER (PARTITION BY id ORDER BY pos), '') <> '') AS gone FROM marks),
own AS (SELECT id, trim(coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (NOT gone), ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS own FROM flags GROUP BY id),
clean AS (SELECT m.*, own FROM messages m JOIN own USING (id)),
quoted AS (SELECT id, pos, length(m) - length(replace(m, '>', '')) AS level, {_NORMAL.format("substr(x, length(m) + 1)")} AS line FROM marks WHERE m <> ''),
starts AS (SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(level) OVER w = level THEN 0 ELSE 1 END AS starts FROM quoted WINDOW w AS (PARTITION BY id ORDER BY pos)),
groups AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY pos) AS run FROM starts),
passages AS (SELECT conv_id, seq, id, run, level, list(line ORDER BY pos) AS lines FROM groups JOIN messages USING (id) WHERE line <> '' AND NOT lone GROUP BY ALL),
texts AS (SELECT *, string_split(array_to_string(lines, ' '), ' ') AS words FROM passages),
sized AS (SELECT *, len(words) AS n, least(len(words), {WINDOW}) AS size FROM texts),
units AS (
    SELECT conv_id, id, run, n, 'w ' || array_to_string(words[k:k + size - 1], ' ') AS unit, k AS start, size, false AS whole FROM (SELECT *, unnest(range(1, n - size + 2)) AS k FROM sized)
    UNION ALL SELECT conv_id, id, run, n, 'l ' || lines[k], CASE WHEN k = 1 THEN 1 ELSE len(string_split(array_to_string(lines[1:k - 1], ' '), ' ')) + 1 END, len(string_split(lines[k], ' ')), true FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS k FROM sized)),
wrote AS (
    SELECT conv_id, min(seq) AS source, lines, any_value({_NORMAL.format("own")}) AS folded FROM (SELECT *, list_transform(string_split(own, chr(10)), lambda x: {_NORMAL.format("x")}) AS lines FROM clean WHERE NOT lone) GROUP BY conv_id, lines),
sources AS (SELECT conv_id, source, lines, string_split(folded, ' ') AS words FROM wrote WHERE folded <> ''),
held AS (
    SELECT DISTINCT conv_id, source, len(words) AS n_source, 'w ' || array_to_string(words[k:k + size - 1], ' ') AS unit FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS k FROM sources, (SELECT unnest(range(1, {WINDOW + 1})) AS size) WHERE len(words) >= size)
    UNION SELECT DISTINCT conv_id, source, len(words), 'l ' || unnest(lines) FROM sources),
met AS (SELECT u.*, source, n_source FROM units u JOIN held USING (conv_id, unit)),
covers AS (
    SELECT id, run, n, source, n_source, count(DISTINCT p) AS cover, count(DISTINCT (start, whole)) AS units, bool_or(whole) AS whole FROM (SELECT *, unnest(range(start, start + size)) AS p FROM met) GROUP BY ALL
    HAVING bool_or(whole) OR 2 * count(DISTINCT p) >= n),
best AS (SELECT p.conv_id, p.seq, p.level, max_by(source, (cover, units, -n_source, source)) AS source FROM passages p JOIN covers c ON p.id = c.id AND p.run = c.run AND source < p.seq GROUP BY p.conv_id, p.seq, p.level, p.run),
linked AS (
    SELECT conv_id, seq, arg_min(source, (level, -source)) AS linked, string_agg(level || ':' || source, ',' ORDER BY level, source) AS links FROM (SELECT DISTINCT * FROM best) GROUP BY ALL),
replies AS (SELECT c.*, coalesce(linked, CASE WHEN c.seq > 0 THEN c.seq - 1 END) AS parent_seq, coalesce(links, '') AS links FROM clean c LEFT JOIN linked l ON c.conv_id = l.conv_id AND c.seq = l.seq),
firsts AS (SELECT *, parent_seq IS NOT NULL AND seq = min(seq) OVER (PARTITION BY conv_id, parent_seq) AS follows FROM replies),
walk AS (
    SELECT conv_id, id, seq, seq AS branch, CAST(0 AS BIGINT) AS position FROM firsts WHERE NOT follows
    UNION ALL SELECT f.conv_id, f.id, f.seq, w.branch, w.position + 1 FROM walk w JOIN firsts f ON f.conv_id = w.conv_id AND f.parent_seq = w.seq WHERE f.follows)
SELECT f.conv_id, CAST(f.seq AS BIGINT) AS seq, f.turn, f.role, f.own AS text, CAST(coalesce(n, 0) AS BIGINT) AS n_quoted, CAST(f.parent_seq AS BIGINT) AS parent_seq, p.turn AS parent_turn, CAST(branch AS BIGINT) AS branch, position, f.links
FROM firsts f JOIN walk USING (id) LEFT JOIN (SELECT id, count(*) AS n FROM quoted GROUP BY id) q USING (id) LEFT JOIN messages p ON p.conv_id = f.conv_id AND p.seq = f.parent_seq
"""
