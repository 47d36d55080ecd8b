"""Chat formatting with typed content parts.

A turn's text is plain, or as a whole a JSON array of parts {"type": "text" | "image" | "audio" |
"document", ...}.  A visitor with one method for each type flattens them: text stays, everything
else becomes a numbered placeholder with a reference and the tokens that it expands to.

Turns are range-partitioned and sorted by conversation, so one pass over each partition visits them
in order, whatever the conversations' sizes.  Only the first conversation of a partition can have
begun in an earlier one: what it has had there is added from a table of one row for each partition.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from math import ceil, isfinite

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import need, read, spool
from .token_counts import VOCABULARY, Vocabulary, count

ROLES = ("system", "user", "assistant", "tool")
#: Characters after which a conversation goes on in another row.
SEGMENT = 16_000_000
#: Tokens that a part counts as at most.
MOST = 2**40
_PIECE = pa.struct([("text", pa.string()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("number", pa.int64())])
_PIECES = "array<struct<text:string,kind:string,ref:string,tokens:long,number:long>>"


@dataclass(frozen=True)
class Piece:
    """What is left of a part: its text, or, where kind is set, the label of its placeholder."""

    text: str
    tokens: int
    kind: str | None = None
    ref: str | None = None


def _number(x) -> float:
    """A number of that size, 0 for what is none."""
    return x if isinstance(x, (int, float)) and not isinstance(x, bool) and isfinite(x) and x > 0 else 0


def _text(x) -> str:
    """As text that UTF-8 can hold."""
    x = x if isinstance(x, str) else json.dumps(x)
    return x.encode("utf-8", "replace").decode()


class Visitor:
    """Each method gets a part and returns a Piece."""

    patch, unknown_image, audio_rate, page_tokens = 28, 256, 25, 512

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        self.vocabulary = Vocabulary(vocabulary)

    def n_tokens(self, text: str) -> int:
        return count(text, self.vocabulary.encoding())

    def text(self, part: dict) -> Piece:
        text = _text(part["text"]) if part.get("text") is not None else ""
        return Piece(text, self.n_tokens(text))

    def _attached(self, part: dict, tokens: float, label: str | None = None) -> Piece:
        kind, ref = _text(part["type"]), part.get("url")
        return Piece(label or kind, int(min(tokens, MOST)), kind, None if ref is None else _text(ref))

    def image(self, part: dict) -> Piece:
        patches = [ceil(min(_number(part.get(side)) / self.patch, MOST)) for side in ("width", "height")]
        return self._attached(part, patches[0] * patches[1] or self.unknown_image)

    def audio(self, part: dict) -> Piece:
        return self._attached(part, ceil(min(_number(part.get("seconds")) * self.audio_rate, MOST)))

    def document(self, part: dict) -> Piece:
        return self._attached(part, max(1, int(min(_number(part.get("pages")), MOST))) * self.page_tokens)

    def other(self, part: dict) -> Piece:
        """A type that isn't known: nothing of it is lost, the part itself is the reference."""
        return self._attached({"type": part["type"], "url": part}, 0, "part")

    KINDS = ("text", "image", "audio", "document")

    def visit(self, part: dict) -> Piece:
        return getattr(self, part["type"] if part["type"] in self.KINDS else "other")(part)

    def turn(self, text: str | None) -> list[Piece]:
        return [self.visit(p) for p in parts(text)]


def parts(text: str | None) -> list[dict]:
    """The typed parts of a turn; plain text is one part of text."""
    if text and text.lstrip()[:1] == "[":
        try:
            found = json.loads(text)
        except (ValueError, RecursionError):
            found = None
        if found and all(isinstance(p, dict) and isinstance(p.get("type"), str) for p in found):
            return found
    return [{"type": "text", "text": text or ""}]


def _flattened(turns: DataFrame, visitor: Visitor) -> DataFrame:
    """(conv_id, turn, role, part, at, before, pieces) for each turn: part and at tell the order over
    all; before (the characters in front of it) and the numbers of pieces count from the beginning of
    the conversation in that partition."""
    ids, order = (turns.schema[c].dataType for c in ("conv_id", "turn"))
    schema = pa.schema([("conv_id", to_arrow_type(ids)), ("turn", to_arrow_type(order)), ("role", pa.string()), ("part", pa.int32()), ("at", pa.int64()), ("before", pa.int64()), ("size", pa.int64()), ("pieces", pa.list_(_PIECE))])

    def run(batches):
        part, at, now, number, before = TaskContext.get().partitionId(), 0, None, 0, 0
        for b in batches:
            rows = []
            for conv, turn, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if conv != now:
                    now, number, before = conv, 0, 0
                pieces = []
                for p in visitor.turn(text):
                    number += p.kind is not None
                    pieces.append({"text": p.text, "kind": p.kind, "ref": p.ref, "tokens": p.tokens, "number": number if p.kind is not None else None})
                size = sum(len(p["text"]) for p in pieces)
                rows.append({"conv_id": conv, "turn": turn, "role": role, "part": part, "at": at, "before": before, "size": size, "pieces": pieces})
                at, before = at + 1, before + size
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    # Turns that are equal in all can take any order among each other; the last key parts many of them.
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark").asc_nulls_first(), F.col("any")]
    ranged = turns.select("conv_id", "turn", role.alias("role"), "text", F.md5(F.encode("text", "UTF-8")).alias("mark"), F.monotonically_increasing_id().alias("any")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ddl = f"conv_id {ids.simpleString()}, turn {order.simpleString()}, role string, part int, at long, before long, size long, pieces {_PIECES}"
    return ranged.select("conv_id", "turn", "role", "text").mapInArrow(run, ddl)


def format_chats(turns: DataFrame, visitor: Visitor | None = None, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, prompt, n_turns, n_tokens, attachments) for each conversation; attachments
    is an array of (number, kind, ref, turn, tokens) in order.

    A conversation is one row, segment 0, up to ``segment`` characters of text; turns that begin
    beyond go into further rows, with numbers that go on.  Turns are in the order of ``turn`` (null
    first), equal ones in that of role and md5 of the text; repeated rows are turns of their own.  A null
    or unknown role is a user's; a null or empty text is an empty turn.  Text is typed only if all
    of it is a JSON array, not empty, of objects with a type; everything else is plain and shown
    as it is.  A part of another type is shown as <part:number> and is its own reference in JSON.
    Sizes that aren't positive numbers count as not given, and no part as more than MOST tokens.
    Rows without conv_id are left out; other columns are ignored; an empty table gives no rows.
    """
    own = need(turns, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    flat = spool(_flattened(own, visitor or Visitor()), "turns")
    had = flat.groupBy("part", "conv_id").agg(F.max(F.array_max(F.transform("pieces", lambda p: p["number"]))).alias("n"), F.max(F.col("before") + F.col("size")).alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = had.withColumns({"n": F.sum(F.coalesce("n", F.lit(0))).over(earlier), "size": F.sum("size").over(earlier)}).where("size IS NOT NULL")
    begun = begun.select(F.col("part").alias("in_part"), F.col("conv_id").alias("conv"), F.col("n").alias("n_before"), F.col("size").alias("size_before"))
    # At most one row for each partition: only its first conversation has begun before.
    whole = flat.join(F.broadcast(begun), (F.col("part") == F.col("in_part")) & (F.col("conv_id") == F.col("conv")), "left")
    nth = lambda p: p["number"] + F.coalesce("n_before", F.lit(0))
    shown = F.array_join(F.transform("pieces", lambda p: F.when(p["kind"].isNull(), p["text"]).otherwise(F.concat(F.lit("<"), p["text"], F.lit(":"), nth(p).cast("string"), F.lit(">")))), "")
    said = F.concat(F.lit("<|"), "role", F.lit("|>\n"), shown, F.lit("<|end|>\n"))
    attached = F.transform(F.filter("pieces", lambda p: p["kind"].isNotNull()), lambda p: F.struct(nth(p).alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"), F.col("turn").alias("turn"), p["tokens"].alias("tokens")))
    tokens = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["tokens"])
    at = F.floor((F.col("before") + F.coalesce("size_before", F.lit(0))) / segment).cast("int")
    each = whole.select("conv_id", at.alias("segment"), F.struct("part", "at", said.alias("said"), attached.alias("attached")).alias("t"), tokens.alias("tokens"))
    chat = each.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list("t"), lambda a, b: F.when(a["part"] != b["part"], a["part"] - b["part"]).otherwise((a["at"] - b["at"]).cast("int"))).alias("t"), F.sum("tokens").alias("n_tokens"))
    return chat.select("conv_id", "segment", F.array_join(F.transform("t", lambda t: t["said"]), "").alias("prompt"), F.size("t").alias("n_turns"), "n_tokens", F.flatten(F.transform("t", lambda t: t["attached"])).alias("attachments"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """format_chats() of all conversations; attachments as JSON."""
    return format_chats(read(spark, sf_dir, "conversations")).withColumn("attachments", F.to_json("attachments"))


# ---- a check in SQL -------------------------------------------------------------------------


class _Letters(Visitor):
    """Counts characters, which SQL can do too."""

    def n_tokens(self, text: str) -> int:
        return len(text)


#: Turns with typed parts, made from the table of plain ones: by the turn's number a text with an
#: image, an audio and a document, a part of an unknown type, JSON with text behind it, or plain text.
TYPED = """
SELECT conv_id, turn, role, CASE turn % 5
  WHEN 0 THEN '[{"type":"text","text":"see "},{"type":"image","url":"i' || conv_id || '.png","width":' || (turn * 100 + 56) || ',"height":28},{"type":"text","text":" and"}]'
  WHEN 1 THEN '[{"type":"audio","url":"a.wav","seconds":' || (turn + 2) || '},{"type":"document","url":"d' || turn || '.pdf","pages":5000000}]'
  WHEN 2 THEN '[{"type":"video","url":"v.mp4"}]'
  WHEN 3 THEN '[{"type":"function"}] please explain'
  ELSE text END AS text FROM conversations"""


def typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """format_chats() of turns with typed parts, tokens being characters."""
    read(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    chats = format_chats(spark.sql(TYPED), _Letters())
    shown = F.transform("attachments", lambda a: F.concat_ws("|", a["number"].cast("string"), a["kind"], a["ref"], a["turn"].cast("string"), a["tokens"].cast("string")))
    return chats.withColumn("attachments", F.array_join(shown, " "))


SQL = f"""
WITH flat AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, CASE WHEN role IN {ROLES} THEN role ELSE 'user' END AS role, CASE turn % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS n
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM flat),
told AS (
  SELECT *, (turn * 100 + 56 + 27) // 28 AS patches,
    CASE turn % 5 WHEN 0 THEN 'see <image:' || (before + 1) || '> and' WHEN 1 THEN '<audio:' || (before + 1) || '><document:' || (before + 2) || '>' WHEN 2 THEN '<part:' || (before + 1) || '>'
      WHEN 3 THEN '[{{"type":"function"}}] please explain' ELSE text END AS shown FROM placed),
counted AS (
  SELECT *, CASE turn % 5 WHEN 0 THEN 8 + patches WHEN 1 THEN (turn + 2) * 25 + 5000000 * 512::BIGINT WHEN 2 THEN 0 ELSE length(shown) END AS tokens,
    CASE turn % 5 WHEN 0 THEN (before + 1) || '|image|i' || conv_id || '.png|' || turn || '|' || patches
      WHEN 1 THEN (before + 1) || '|audio|a.wav|' || turn || '|' || ((turn + 2) * 25) || ' ' || (before + 2) || '|document|d' || turn || '.pdf|' || turn || '|' || (5000000 * 512::BIGINT)
      WHEN 2 THEN (before + 1) || '|video|{{"type": "video", "url": "v.mp4"}}|' || turn || '|0' END AS attached FROM told)
SELECT conv_id, 0::INTEGER AS segment, string_agg('<|' || role || '|>' || chr(10) || shown || '<|end|>' || chr(10), '' ORDER BY turn, role, md5(text)) AS prompt, count(*)::INTEGER AS n_turns,
  sum(tokens)::BIGINT AS n_tokens, coalesce(string_agg(attached, ' ' ORDER BY turn, role, md5(text)), '') AS attachments
FROM counted GROUP BY conv_id
"""
