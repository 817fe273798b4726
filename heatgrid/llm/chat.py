r"""Chat formatting with a grammar round trip, in DataFrame functions alone.

    conversation := turn*
    turn         := "<s>" role "\n" body "</s>"
    body         := "[INST] " text " [/INST]" for the role user, else text

A newline in a role is written [LF]. Neither a role nor a text may hold a control string (`<s>`, `</s>`, `[INST]`,
`[/INST]`, `[LF]`): the parser gives none for a turn that does. A turn is first rendered as it is and parsed again; where
that does not give back its role and text, control strings in them get one more backslash after their first character
(`</s>` becomes `<\/s>`, `<\/s>` becomes `<\\/s>`), which the parser takes out again, until what is read equals what was
written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatgrid.llm.common import table

USER, ASSISTANT = "user", "assistant"
BEGIN, END, LINE, OPEN, CLOSE = "<s>", "</s>", "[LF]", "[INST] ", " [/INST]"
CHUNK = 64
_TAIL = r"(/?s>|/?INST\]|LF\])"
_CONTROL = r"</?s>|\[/?INST\]|\[LF\]"


def escape(text: Column) -> Column:
    """Put one more backslash into every control string, escaped before or not."""
    return F.regexp_replace(text, rf"([<\[])(\\*){_TAIL}", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    """Take one backslash out of every escaped control string."""
    return F.regexp_replace(text, rf"([<\[])(\\*)\\{_TAIL}", "$1$2$3")


def _render(role: Column, text: Column) -> Column:
    body = F.when(role == USER, F.concat(F.lit(OPEN), text, F.lit(CLOSE))).otherwise(text)
    return F.concat(F.lit(BEGIN), F.replace(role, F.lit("\n"), F.lit(LINE)), F.lit("\n"), body, F.lit(END))


def _read(piece: Column) -> Column:
    """(role, text) of what stands before an END; one with a control string in it is null."""
    line = F.locate("\n", piece)
    head = F.substring(piece, F.lit(len(BEGIN) + 1), line - (len(BEGIN) + 1))
    name = F.replace(head, F.lit(LINE), F.lit("\n"))
    own = lambda x: F.when(~F.rlike(x, F.lit(_CONTROL)), unescape(x))
    role = own(name)
    body = F.substring(piece, line + 1, F.length(piece))
    inner = F.substring(body, F.lit(len(OPEN) + 1), F.length(body) - len(OPEN) - len(CLOSE))
    return F.struct(role.alias("role"), own(F.when(name == USER, inner).otherwise(body)).alias("text"))


def pieces(formatted: Column) -> Column:
    """The turns of a rendered conversation, without their ENDs."""
    parts = F.split(formatted, END, -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def parse(formatted: Column) -> Column:
    """The (role, text) turns of a rendered conversation."""
    return F.transform(pieces(formatted), _read)


def _comes_back(rendered: Column, role: Column, text: Column) -> Column:
    """Whether a rendered turn is read as one turn, of this role and text."""
    turns = parse(rendered)
    same = F.get(turns, F.lit(0)).eqNullSafe(F.struct(role.alias("role"), text.alias("text")))
    return (F.size(turns) == 1) & F.endswith(rendered, F.lit(END)) & same


def format_conversations(rows: DataFrame) -> DataFrame:
    """Render each conversation of `rows` (conv_id, turn, role, text) in order of turn.

    Returns conv_id, formatted, loss_spans (of each assistant text: number of the turn, place `at` in its piece, place
    `start` in `formatted`, both from 0, and length) and round_trip (whether parse(formatted) equals the source).
    Null roles and texts are empty strings. Rows with equal turns follow by role, then text; null turns come first; a
    null conv_id is a conversation of its own. Other columns are not used. Turns are joined in chunks of CHUNK turn
    numbers first, so that a conversation with very many turns is rendered by many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # names of our own, whatever else the table has
    rows = rows.select(F.col("conv_id"), F.col("turn"), role.alias("role"), text.alias("text"))
    raw = _render(F.col("role"), F.col("text"))
    rows = rows.withColumn("rendered", F.when(_comes_back(raw, F.col("role"), F.col("text")), raw).otherwise(_render(escape(F.col("role")), escape(F.col("text")))))
    head = F.locate("\n", F.col("rendered"))
    is_loss = F.col("role") == ASSISTANT
    # of the source only a hash goes along; where turns and roles are equal, the order of texts is read from the turns
    source = F.xxhash64("role", "text")
    turn = F.struct("turn", "role", "rendered", source.alias("source"), is_loss.alias("loss"), head.alias("at"), (F.length("rendered") - head - len(END)).alias("length"))
    chunk = F.floor(F.coalesce(F.col("turn"), F.lit(-(1 << 62))) / CHUNK)
    chunks = rows.groupBy("conv_id", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(turn), _in_order).alias("turns"))
    chunks = chunks.withColumn("formatted", F.array_join(F.transform("turns", lambda t: t["rendered"]), "")).withColumn("n", F.size("turns"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumns({"offset": F.coalesce(F.sum(F.length("formatted")).over(before), F.lit(0)), "first": F.coalesce(F.sum("n").over(before), F.lit(0))})

    def span(t: Column, i: Column) -> Column:
        earlier = F.aggregate(F.slice(F.col("turns"), F.lit(1), i), F.col("offset"), lambda a, x: a + F.length(x["rendered"]))
        return F.when(t["loss"], F.struct((F.col("first") + i).alias("turn"), t["at"].cast("long").alias("at"), (earlier + t["at"]).alias("start"), t["length"].cast("long").alias("length")))

    spans = F.filter(F.transform("turns", span), lambda s: s.isNotNull())
    part = F.struct("chunk", "formatted", spans.alias("spans"), F.transform("turns", lambda t: t["source"]).alias("source"))
    whole = chunks.select("conv_id", part.alias("part")).groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    formatted = F.array_join(F.transform("parts", lambda p: p["formatted"]), "")
    spans = F.flatten(F.transform("parts", lambda p: p["spans"]))
    source = F.flatten(F.transform("parts", lambda p: p["source"]))
    whole = whole.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"), source.alias("source"))
    read = F.transform(parse(F.col("formatted")), lambda t: F.xxhash64(t["role"], t["text"]))
    return whole.select("conv_id", "formatted", "loss_spans", (read == F.col("source")).alias("round_trip"))


def _in_order(a: Column, b: Column) -> Column:
    """Turns by number (null first), role and text; the text is taken from the rendered turn only if the others are equal."""

    def by(x: Column, y: Column, rest: Column) -> Column:
        return F.when(x.isNull() & y.isNotNull(), -1).when(x.isNotNull() & y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(rest)

    text = lambda t: _read(F.substring(t["rendered"], F.lit(1), F.length(t["rendered"]) - len(END)))["text"]
    return by(a["turn"], b["turn"], by(a["role"], b["role"], by(text(a), text(b), F.lit(0))))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    own = pieces(formatted)
    cut = F.transform(F.array(own), lambda p: F.transform(spans, lambda s: unescape(F.substring(F.get(p, s["turn"].cast("int")), s["at"].cast("int") + 1, s["length"].cast("int")))))
    return F.array_join(F.get(cut, F.lit(0)), "")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    clash = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, USER).otherwise(ASSISTANT).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    done = format_conversations(conversations.union(clash))
    turns = parse(F.col("formatted"))
    done = done.withColumn("turns", turns).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS r(i)),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|LF\])', '\1\2\\\3', 'g')) AS body,
    length(replace(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|LF\])', '\1\2\\\3', 'g'), chr(10), '[LF]')) AS head FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(3 + head + 1 + body + CASE role WHEN 'user' THEN 15 ELSE 0 END + 4)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
