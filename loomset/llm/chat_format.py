"""Chat formatting: conversations to text segments with loss flags, by a declarative template and a finite-state machine over roles.

Defined cases: a null text or role counts as empty; turns are ordered by (turn, role, text), null turns first, so ties and repeated rows have
one order; a null conv_id is a conversation of its own; an empty table gives no rows; further columns are ignored. A conversation that the
machine refuses is still formatted, with valid = false and the index of the first turn refused. A conversation's text is one value, so it has
to fit in one row (2 GB).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Each turn becomes header + role + colon + escaped text + footer. Inside texts, each control string is broken by a backslash after its first character, and backslashes are doubled."""

    header: str = "### "
    colon: str = ": "
    footer: str = "</turn>\n"
    #: Strings that mark turns and so mustn't stand in texts.
    controls: tuple[str, ...] = ("### ", "</turn>")
    #: Role -> how it's shown; other roles are shown as @role.
    roles: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    #: Roles whose texts count for the loss.
    loss: tuple[str, ...] = ("assistant",)
    #: State -> role -> next state. What's missing is refused.
    machine: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "briefed", "user": "asked"}, "briefed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    accept: tuple[str, ...] = ("answered",)


def escape(text: Column, t: Template) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in t.controls:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _shown(role: Column, t: Template) -> Column:
    """The role as shown; a colon or line break in a role of its own is broken like a control string."""
    other = F.concat(F.lit("@"), F.replace(F.replace(escape(role, t), F.lit(":"), F.lit("\\:")), F.lit("\n"), F.lit("\\\n")))
    shown = other
    for k, v in t.roles.items():
        shown = F.when(role == k, F.lit(v)).otherwise(shown)
    return shown


def format_conversations(turns: DataFrame, t: Template = Template()) -> DataFrame:
    """conv_id, n_turns, segments (text, role, turn index, loss), formatted, end_state, valid, bad_turn (null if valid)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    grouped = turns.select("conv_id", F.struct(F.col("turn"), empty("role").alias("role"), empty("text").alias("text")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    steps = F.create_map(*[F.lit(x) for s, by in t.machine.items() for role, to in by.items() for x in (f"{s} {role}", to)])
    # each state holds its name and the index of the first refused turn, or -1
    walk = F.aggregate(
        "turns",
        F.struct(F.lit("start").alias("state"), F.lit(0).alias("i"), F.lit(-1).alias("bad")),
        lambda a, x: F.struct(
            F.coalesce(F.try_element_at(steps, F.concat(a.state, F.lit(" "), x.role)), F.lit("refused")).alias("state"),
            (a.i + 1).alias("i"),
            F.when((a.bad < 0) & F.try_element_at(steps, F.concat(a.state, F.lit(" "), x.role)).isNull(), a.i).otherwise(a.bad).alias("bad"),
        ),
    )
    piece = lambda text, role, i, loss: F.struct(text.alias("text"), role.alias("role"), i.alias("turn"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x, i: F.array(
                piece(F.concat(F.lit(t.header), _shown(x.role, t), F.lit(t.colon)), x.role, i, F.lit(False)),
                piece(escape(x.text, t), x.role, i, x.role.isin(*t.loss)),
                piece(F.lit(t.footer), x.role, i, F.lit(False)),
            ),
        )
    )
    return (
        grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), walk.alias("w"), segments.alias("segments"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s.text), ""))
        .select("conv_id", "n_turns", "segments", "formatted", F.col("w.state").alias("end_state"), ((F.col("w.bad") < 0) & F.col("w.state").isin(*t.accept)).alias("valid"), F.when(F.col("w.bad") >= 0, F.col("w.bad")).otherwise(F.when(~F.col("w.state").isin(*t.accept), F.col("w.i"))).alias("bad_turn"))
    )


def read_turns(formatted: Column, t: Template = Template()) -> Column:
    """The inverse, from the text alone: array of (role, text). Footers stand only at ends of turns, so the text is cut there."""
    cut = F.split(formatted, f"\\Q{t.footer}\\E", -1)
    back = F.create_map(*[F.lit(x) for k, v in t.roles.items() for x in (v, k)])

    def turn(x: Column) -> Column:
        shown = F.regexp_extract(x, rf"(?s)^\Q{t.header}\E((?:[^\\:]++|\\.)*):", 1)
        role = F.when(F.startswith(shown, F.lit("@")), unescape(F.substring(shown, 2, 1 << 30))).otherwise(F.try_element_at(back, shown))
        text = F.substring(x, F.length(shown) + len(t.header) + len(t.colon) + 1, F.lit(2**31 - 1))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0))), turn)


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations and conversation -7, read back from the output."""
    tricky = spark.sql(r"""SELECT -7L AS conv_id, t.turn, t.role, r'\### Assistant: </turn> ok' AS text FROM (SELECT explode(array(named_struct('turn', 0L, 'role', 'user'), named_struct('turn', 1L, 'role', 'assistant'))) AS t)""")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(tricky)
    back = format_conversations(turns).withColumn("back", read_turns(F.col("formatted")))
    lossy = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text)), "")
    return back.withColumn("learned", lossy).select(
        "conv_id", F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", F.col("bad_turn").cast("long").alias("bad_turn"),
    )


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), steps AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>') AS escaped,
    CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
      ELSE '@' || replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), ':', '\:'), chr(10), '\' || chr(10)) END AS shown,
    row_number() OVER w - 1 AS i, lag(role) OVER w AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) = 1 AS final
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), judged AS (
  SELECT *, CASE WHEN role = 'system' THEN i = 0 WHEN role = 'user' THEN i = 0 OR before IN ('system', 'assistant') WHEN role = 'assistant' THEN i > 0 AND before = 'user' ELSE false END AS good FROM steps
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || shown || ': ' || escaped || '</turn>' || chr(10)))::BIGINT AS formatted_chars,
  bool_and(good) AND bool_or(final AND role = 'assistant') AS valid,
  CASE WHEN bool_and(good) AND bool_or(final AND role = 'assistant') THEN NULL ELSE coalesce(min(i) FILTER (NOT good), count(*)) END::BIGINT AS bad_turn
FROM judged GROUP BY conv_id
"""
