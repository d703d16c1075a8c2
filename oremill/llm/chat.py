"""Chat formatting: a finite-state machine over roles and a declarative template give text segments with loss flags.

Native: DataFrame functions only.  The first characters of the template's marks are escaped in texts and roles, so no
mark of whatever template can begin inside a turn and the formatted conversation can be read back exactly.

Defined results: a null text or role reads as the empty string; a null turn sorts first; turns with equal numbers are
ordered by role, then text, and each counts; rows of a null conv_id form one conversation; an empty table gives an
empty result; extra input columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, narrowed


@dataclass(frozen=True)
class Template:
    """Marks round a turn, roles under the loss, and the legal moves of the machine from `start`."""

    turn_mark: str = "<|turn|>"
    role_end: str = "\n"
    end_mark: str = "<|end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )

    def __post_init__(self):
        """A mark may not begin with a character of an escape, nor an end mark arise where another mark meets a text."""
        for mark in (self.turn_mark, self.role_end, self.end_mark):
            if not mark or mark[0] in "&;0123456789":
                raise ValueError(f"no mark can be {mark!r}")
        for mark in (self.turn_mark, self.role_end):
            if self.end_mark in mark or any(self.end_mark.startswith(mark[i:]) for i in range(len(mark))):
                raise ValueError(f"{self.end_mark!r} can begin inside {mark!r}")


def escapes(template: Template, role: bool = False) -> list[tuple[str, str]]:
    """(plain, escaped) in the order in which escaping applies them; unescaping goes backwards."""
    marks = (template.turn_mark, template.end_mark, *((template.role_end,) if role else ()))
    return [("&", "&38;"), *((c, f"&{ord(c)};") for c in sorted({m[0] for m in marks}))]


def escape(text: Column, template: Template, role: bool = False) -> Column:
    """Take the first characters of marks out of a text; those of role_end too where it is a role."""
    for plain, code in escapes(template, role):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, template: Template, role: bool = False) -> Column:
    for plain, code in reversed(escapes(template, role)):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted, loss_spans (code points of `formatted`: start, length), first_bad_turn (null: legal order), open_ended."""
    rows = narrowed(turns, "conv_id", "turn", "role", "text").select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    legal = F.create_map(*[F.lit(x) for a, b in template.moves.items() for x in (a, "|" + "|".join(b) + "|")])

    def move(held: Column, turn: Column) -> Column:
        allowed = F.coalesce(F.contains(F.try_element_at(legal, held["state"]), F.concat(F.lit("|"), turn["role"], F.lit("|"))), F.lit(False))
        return F.struct(
            turn["role"].alias("state"),
            (held["at"] + 1).alias("at"),
            F.when(held["bad"].isNull() & ~allowed, held["at"]).otherwise(held["bad"]).alias("bad"),
        )

    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    parts = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(F.concat(F.lit(template.turn_mark), escape(t["role"], template, True), F.lit(template.role_end)), no),
                segment(escape(t["text"], template), t["role"].isin(*template.trained)),
                segment(F.lit(template.end_mark), no),
            ),
        )
    )

    def place(held: Column, part: Column) -> Column:
        span = F.struct(held["at"].alias("start"), F.length(part["text"]).alias("length"))
        return F.struct((held["at"] + F.length(part["text"])).alias("at"), F.when(part["loss"], F.concat(held["spans"], F.array(span))).otherwise(held["spans"]).alias("spans"))

    nowhere = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return chats.select("conv_id", F.aggregate("turns", begin, move).alias("machine"), parts.alias("segments")).select(
        "conv_id",
        "segments",
        F.aggregate("segments", nowhere, place)["spans"].alias("loss_spans"),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("machine.bad").alias("first_bad_turn"),
        (F.col("machine.state") != template.trained[0]).alias("open_ended"),
    )


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """The turns, parsed from `formatted` alone, and loss_texts, cut from `formatted` at loss_spans; both unescaped."""
    quoted = "\\Q" + template.end_mark + "\\E"
    pieces = F.slice(F.split("formatted", quoted), 1, F.greatest(F.size(F.split("formatted", quoted)) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(template.turn_mark) + 1))
        role = F.substring_index(body, template.role_end, 1)
        return F.struct(
            unescape(role, template, True).alias("role"), unescape(F.substr(body, F.length(role) + len(template.role_end) + 1), template).alias("text")
        )

    cut = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]), template))
    return chats.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_texts", cut)


PROBE = r"\### Assistant: </turn> ok"


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user's and an assistant's turn that say what looks like marks."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    return spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all conversations and the probe conversation -7, formatted, read back and digested."""
    turns = narrowed(load(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe(spark))
    back = read_back(format_chats(turns))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(8 + length(replace(replace(replace(role, '&', '&38;'), '<', '&60;'), chr(10), '&10;')) + 1
    + length(replace(replace(text, '&', '&38;'), '<', '&60;')) + 8) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
