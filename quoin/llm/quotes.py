"""Chat formatting by quotation linking. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.lineage import cut
from quoin.operators import windows

MARKS = r"^(?:[ \t]*>)+"
# Fixed value: the line mail programs put before a quotation.
ATTRIBUTION = r"^[ \t]*(?:On .{1,300} wrote:|-{2,}[ ]?Original Message[ ]?-{2,})[ \t]*$"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _lines(text: Column) -> Column:
    """Each line as (level, body): how many quote marks lead it, and what follows them."""
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", ""))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS + "[ ]?", "").alias("text")))


def _passages(lines: str) -> Column:
    """Runs of lines of one level, as (level, text)."""
    starts = F.expr(f"filter(sequence(1, size({lines})), i -> i = 1 or {lines}[i - 1].level <> {lines}[i - 2].level)")
    cuts = F.concat(starts, F.array(F.size(lines) + 1))
    runs = F.zip_with(starts, F.slice(cuts, 2, F.size(starts)), lambda a, b: F.struct(F.get(F.col(lines), a - 1)["level"].alias("level"), F.array_join(F.transform(F.slice(lines, a, b - a), lambda x: x["text"]), "\n").alias("text")))
    return F.when(F.size(lines) > 0, runs)


def _keys(*pairs: Column) -> Column:
    """Distinct (hash, length, level) of (level, normalised text) whose text isn't empty."""
    normal = F.filter(F.transform(F.concat(*pairs), lambda x: F.struct(x["level"].alias("level"), _normal(x["text"]).alias("text"))), lambda x: x["text"] != "")
    return F.array_distinct(F.transform(normal, lambda x: F.struct(F.xxhash64(x["text"]).alias("hash"), F.length(x["text"]).alias("length"), x["level"].alias("level"))))


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: (conv_id, turn, role, content, n_quotes, max_level, reply_to, root_turn, depth, position, rendered).

    A message's lines are parsed into nested quote levels; quoted passages, and their single lines,
    are normalised (lower case, one space for white space) and hashed, and joined by conversation,
    hash and length to the passages and lines that messages wrote themselves. The passage's original
    is the earliest message of the conversation that has it. Of the originals of a message's quotes
    the one least deeply quoted (then with most matched characters, then the latest) is its reply_to. root_turn is the message
    at the start of the chain of replies and depth its length, found by pointer doubling. position is
    the message's place in its conversation by (root_turn, depth, turn), in which each reply comes
    behind what it answers; built() puts conversations together in that order. content is the text
    without quotes and lines announcing them, rendered the message in chat form.

    A quote of nothing known, or only of later messages, links to nothing: reply_to is null, the
    message is its own root at depth 0. Null texts are empty messages; null conversations and turns
    link with nothing and have no position; a null turn has a null root. Repeated rows stay and agree;
    of different messages with one turn a reply is to that turn, and messages of equal root, depth and
    turn share a position. An empty table gives no rows; other columns are
    ignored.
    """
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    quotes = F.coalesce(F.col("text").contains(">") & F.col("text").rlike("(?m)" + MARKS), F.lit(False))
    bare = lambda x: F.btrim(x, F.lit(" \t\n\r\x0b\f"))
    of = lambda name, quoted: F.filter(name, lambda x: (x["level"] > 0) == F.lit(quoted))

    def parsed(some: DataFrame) -> DataFrame:
        kept = F.filter(of("lines", False), lambda x: ~x["text"].rlike(ATTRIBUTION))
        some = some.withColumn("lines", _lines(F.col("text"))).withColumn("runs", _passages("lines"))
        return some.withColumn("kept", kept).withColumn("content", bare(F.array_join(F.transform("kept", lambda x: x["text"]), "\n")))

    base = rows.withColumn("mark", F.xxhash64("text"))
    # only messages with a quoted line are parsed to lines; most have none
    # (the optimizer tests an exploded list's size before other filters, hence the condition on the text itself)
    with_quotes = parsed(base.where(quotes).withColumn("text", F.when(quotes, F.col("text")))).select(
        *base.columns,
        "content",
        F.size(of("runs", True)).alias("n_quotes"),
        F.array_max(F.transform("lines", lambda x: x["level"])).alias("max_level"),
        _keys(of("runs", True), of("lines", True)).alias("quoted"),
    )
    without = base.where(~quotes).select(*base.columns, bare(F.coalesce("text", F.lit(""))).alias("content"), F.lit(0).alias("n_quotes"), F.lit(0).alias("max_level"))
    quoting = with_quotes.where("conv_id is not null and turn is not null")
    asked = cut(quoting.select("conv_id", "turn", "mark", F.explode("quoted").alias("key")).select("conv_id", "turn", "mark", "key.hash", "key.length", "key.level").distinct())
    wanted = asked.select("conv_id", "hash", "length").distinct()
    quoted_in = asked.select("conv_id").distinct()
    written = _keys(of("runs", False), F.col("kept"), F.array(F.struct(F.lit(0).alias("level"), F.col("content").alias("text"))))
    said = parsed(base.where("turn is not null").join(quoted_in, "conv_id", "left_semi")).select("conv_id", "turn", F.explode(written).alias("key"))
    origin = said.select("conv_id", "turn", "key.hash", "key.length").join(wanted, ["conv_id", "hash", "length"], "left_semi").groupBy("conv_id", "hash", "length").agg(F.min("turn").alias("origin"))
    votes = asked.join(origin, ["conv_id", "hash", "length"]).where("origin < turn").groupBy("conv_id", "turn", "mark", "origin").agg(F.sum("length").alias("chars"), F.min("level").alias("level"))
    replies = cut(votes.groupBy("conv_id", "turn", "mark").agg(F.max_by("origin", F.struct(-F.col("level"), "chars", "origin")).alias("reply_to")))
    chain = replies.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("above")).withColumn("steps", F.lit(1).cast("long"))
    while True:
        up = chain.select("conv_id", F.col("turn").alias("above"), F.col("above").alias("next"), F.col("steps").alias("more"))
        chain = cut(chain.join(up, ["conv_id", "above"], "left").select("conv_id", "turn", F.coalesce("next", "above").alias("above"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")))
        if chain.where("moved").isEmpty():
            break
        chain = chain.drop("moved")
    roots = chain.select("conv_id", F.col("turn").alias("reply_to"), F.col("above").alias("root"), "steps")
    tied = replies.join(roots, ["conv_id", "reply_to"], "left").select("conv_id", "turn", "mark", "reply_to", F.coalesce("root", "reply_to").alias("root"), (F.coalesce("steps", F.lit(0)) + 1).alias("depth"))
    # places of distinct messages: a hot conversation is spread over ranges of (root, depth, turn)
    depths = base.where("conv_id is not null and turn is not null").select("conv_id", "turn", "mark").distinct().join(tied.drop("reply_to"), ["conv_id", "turn", "mark"], "left")
    depths = cut(depths.select("conv_id", "turn", "mark", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth")))
    places = windows.ranked(depths.select("conv_id", "root", "depth", "turn").distinct(), ["conv_id"], ["root", "depth", "turn"], "position")
    tied = depths.join(places, ["conv_id", "root", "depth", "turn"]).join(replies, ["conv_id", "turn", "mark"], "left")
    linked = with_quotes.drop("quoted").unionByName(without).join(tied, ["conv_id", "turn", "mark"], "left")
    return linked.select(
        "conv_id",
        "turn",
        "role",
        "content",
        "n_quotes",
        "max_level",
        "reply_to",
        F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "position",
        F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.col("content"), F.lit("<|im_end|>\n")).alias("rendered"),
    )


def built(linked: DataFrame, most: int = 1000) -> DataFrame:
    """(conv_id, part, first, messages, text): conversations in the order of replies, without quotes, in chat form.

    linked is what link() returns. A conversation of over most positions is put together in parts of
    as many, so that no row or task holds an unbounded one; parts joined in order give the whole.
    Messages without a conversation or turn, and empty ones, are left out; repeated rows count once;
    messages of one position come in the order of their text. An empty table gives no rows.
    """
    own = linked.where("position is not null and content <> ''").select("conv_id", F.floor(F.col("position") / F.lit(most)).cast("long").alias("part"), "position", "rendered").distinct()
    rows = own.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("position", "rendered"))).alias("all"))
    return rows.select("conv_id", "part", F.col("all")[0]["position"].alias("first"), F.size("all").alias("messages"), F.array_join(F.transform("all", lambda x: x["rendered"]), "").alias("text"))


# The same in DuckDB; messages are told apart by row, passages by their normalised text.
ORACLE = r"""WITH RECURSIVE base AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, text FROM conversations),
ls AS (SELECT *, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS l, coalesce(regexp_matches(text, '(?m)^(?:[ \t]*>)+'), false) AS has FROM base),
li AS (SELECT rid, conv_id, turn, has, i, length(regexp_replace(regexp_extract(l[i], '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level, regexp_replace(l[i], '^(?:[ \t]*>)+[ ]?', '') AS body FROM ls, unnest(range(1, len(l) + 1)) AS r(i)),
cu AS (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY rid ORDER BY i) = level THEN 0 ELSE 1 END AS cut FROM li),
ru AS (SELECT *, sum(cut) OVER (PARTITION BY rid ORDER BY i) AS run FROM cu),
pa AS (SELECT rid, conv_id, turn, has, level, string_agg(body, chr(10) ORDER BY i) AS body FROM ru GROUP BY rid, conv_id, turn, has, level, run),
kept AS (SELECT * FROM li WHERE level = 0 AND NOT regexp_matches(body, '^[ \t]*(?:On .{1,300} wrote:|-{2,}[ ]?Original Message[ ]?-{2,})[ \t]*$')),
jo AS (SELECT rid, string_agg(body, chr(10) ORDER BY i) AS body FROM kept GROUP BY rid),
ct AS (SELECT b.*, b.has AS quotes, trim(CASE WHEN b.has THEN coalesce(j.body, '') ELSE coalesce(b.text, '') END, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS content FROM ls b LEFT JOIN jo j ON j.rid = b.rid),
qk AS (SELECT DISTINCT rid, conv_id, turn, level, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) AS k FROM (SELECT rid, conv_id, turn, level, body FROM pa WHERE level > 0 UNION ALL SELECT rid, conv_id, turn, level, body FROM li WHERE level > 0) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
wk AS (SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) AS k FROM (SELECT conv_id, turn, body FROM pa WHERE level = 0 UNION ALL SELECT conv_id, turn, body FROM kept UNION ALL SELECT conv_id, turn, content FROM ct) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
og AS (SELECT conv_id, k, min(turn) AS origin FROM wk WHERE k <> '' GROUP BY conv_id, k),
vo AS (SELECT q.rid, q.conv_id, q.turn, o.origin, sum(length(q.k)) AS chars, min(q.level) AS level FROM qk q JOIN og o ON o.conv_id = q.conv_id AND o.k = q.k WHERE o.origin < q.turn GROUP BY ALL),
re AS (SELECT rid, conv_id, turn, origin AS reply_to FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level, chars DESC, origin DESC) AS n FROM vo) WHERE n = 1),
up AS (SELECT conv_id, turn, min(reply_to) AS above FROM re GROUP BY conv_id, turn),
wa(conv_id, turn, head, steps) AS (SELECT conv_id, turn, above, 1 FROM up UNION ALL SELECT w.conv_id, w.turn, u.above, w.steps + 1 FROM wa w JOIN up u ON u.conv_id = w.conv_id AND u.turn = w.head),
ro AS (SELECT conv_id, turn, arg_max(head, steps) AS root, max(steps) AS steps FROM wa GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, c.role, c.content, CAST((SELECT count(*) FROM pa WHERE pa.rid = c.rid AND pa.level > 0) AS INTEGER) AS n_quotes,
  CAST((SELECT max(level) FROM li WHERE li.rid = c.rid) AS INTEGER) AS max_level, re.reply_to,
  CASE WHEN re.reply_to IS NULL THEN c.turn ELSE coalesce(ro.root, re.reply_to) END AS root_turn,
  CAST(CASE WHEN re.reply_to IS NULL THEN 0 ELSE coalesce(ro.steps, 0) + 1 END AS BIGINT) AS depth,
  CASE WHEN c.conv_id IS NOT NULL AND c.turn IS NOT NULL THEN dense_rank() OVER (PARTITION BY c.conv_id, c.turn IS NULL ORDER BY CASE WHEN re.reply_to IS NULL THEN c.turn ELSE coalesce(ro.root, re.reply_to) END, CASE WHEN re.reply_to IS NULL THEN 0 ELSE coalesce(ro.steps, 0) + 1 END, c.turn) - 1 END AS position,
  '<|im_start|>' || coalesce(c.role, '') || chr(10) || c.content || '<|im_end|>' || chr(10) AS rendered
FROM ct c LEFT JOIN re ON re.rid = c.rid LEFT JOIN ro ON ro.conv_id = re.conv_id AND ro.turn = re.reply_to"""

# Every other message quotes the one before it, and each fourth of them what that one quoted, as a table in SQL.
QUOTED = r"""firsts AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn),
quoted AS (SELECT c.conv_id, c.turn, c.role, CASE WHEN c.turn % 2 = 1 AND p.text IS NOT NULL THEN '> ' || replace(p.text, chr(10), chr(10) || '> ') || chr(10) ELSE '' END
  || CASE WHEN c.turn % 4 = 3 AND q.text IS NOT NULL THEN '>> ' || replace(q.text, chr(10), chr(10) || '> > ') || chr(10) ELSE '' END || coalesce(c.text, '') AS text
  FROM conversations c LEFT JOIN firsts p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 LEFT JOIN firsts q ON q.conv_id = c.conv_id AND q.turn = c.turn - 2)"""


def with_quotations(messages: DataFrame) -> DataFrame:
    """The table of QUOTED: messages(conv_id, turn, role, text) of which every other one quotes the one before."""
    first = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    before = lambda n, name: first.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(name))
    joined = messages.select("conv_id", "turn", "role", "text").join(before(1, "p"), ["conv_id", "turn"], "left").join(before(2, "q"), ["conv_id", "turn"], "left")
    quote = lambda when, name, mark: F.when(when & F.col(name).isNotNull(), F.concat(F.lit(mark[0]), F.replace(F.col(name), F.lit("\n"), F.lit("\n" + mark[1])), F.lit("\n"))).otherwise("")
    text = F.concat(quote(F.col("turn") % 2 == 1, "p", ("> ", "> ")), quote(F.col("turn") % 4 == 3, "q", (">> ", "> > ")), F.coalesce("text", F.lit("")))
    return joined.select("conv_id", "turn", "role", text.alias("text"))


def quoted_oracle() -> str:
    """ORACLE over the table of QUOTED."""
    return ORACLE.replace("WITH RECURSIVE base AS", f"WITH RECURSIVE {QUOTED}, base AS").replace("conv_id, turn, role, text FROM conversations)", "conv_id, turn, role, text FROM quoted)")
