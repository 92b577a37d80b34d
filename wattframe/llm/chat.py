"""Chat formatting: records of many layouts become canonical turns, and these one marked text with a loss mask.

A record is a variant (from JSON or from columns). Its layout is recognised by fingerprints, hashes of nested field
paths: each declarative mapping has the fingerprint of the paths it needs, and of those that a record shows, the one
with most paths is selected (lists of turns first). All other fields are metadata and do not count.

The text marks turns with control strings. Where a turn itself contains one, a backslash is put behind its first
character (one more where there are some already), so that marks stay unique and reading back is exact.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.llm.words import let

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
ASSISTANT = "assistant"
# What common chat templates use as control strings.
_MARK = r"\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>"
_BRACKET = r"/?INST\]"
_ESCAPE = rf"(<)(\\*)({_MARK})|(\[)(\\*)({_BRACKET})"
_UNESCAPE = rf"(<)\\(\\*)({_MARK})|(\[)\\(\\*)({_BRACKET})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1$4\\$2$5$3$6")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$4$2$5$3$6")


@dataclass(frozen=True)
class Layout:
    """Either a list of turns (`items`, `role`, `text`), or `fixed` turns of (role, path), which come before those of a
    list; or one turn per record, with the role under `role` and the text under `text`.

    `paths` must occur, whatever else does; the text of a list's items may be missing.
    """

    name: str
    items: str | None = None
    role: str | None = None
    text: str | None = None
    fixed: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> list[str]:
        own = [f"{self.items}[0].{self.role}"] if self.items else [] if self.fixed else [self.role, self.text]
        return sorted([*own, *[p for _, p in self.fixed]])

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)

    def turns(self, record: Column) -> Column:
        """array<struct<role, text>>; what is missing or no text becomes empty."""
        def get(path: str) -> Column:
            return _said(F.try_variant_get(record, f"$.{path}", "variant"))

        turns = [F.array(*[F.struct(F.lit(role).alias("role"), get(path).alias("text")) for role, path in self.fixed])] if self.fixed else []
        if self.items:
            found = F.try_variant_get(record, f"$.{self.items}", f"array<struct<`{self.role}`: string, `{self.text}`: variant>>")
            listed = F.transform(found, lambda t: F.struct(
                _common_role(F.coalesce(t[self.role], F.lit(""))).alias("role"), _said(t[self.text]).alias("text")))
            turns.append(F.coalesce(listed, F.array().cast("array<struct<role: string, text: string>>")))
        if not turns:
            turns = [F.array(F.struct(_common_role(get(self.role)).alias("role"), get(self.text).alias("text")))]
        return F.concat(*turns)


def _said(content: Column) -> Column:
    """The text of a content: as it is, or the texts of a list of parts one behind the other; parts without a text,
    such as images, say nothing."""
    parts = F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda p: F.coalesce(
        F.try_variant_get(p, "$.text", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")), F.lit("")))
    return F.coalesce(F.array_join(parts, ""), F.try_variant_get(content, "$", "string"), F.lit(""))


def _common_role(role: Column) -> Column:
    return F.when(role == "human", "user").when(role.isin("gpt", "bot", "model"), ASSISTANT).otherwise(role)


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.md5(",".join(sorted(paths)).encode()).hexdigest()


_ASK = "user"
LAYOUTS: tuple[Layout, ...] = (
    Layout("turn", role="role", text="text"),
    Layout("messages", "messages", "role", "content"),
    Layout("system_messages", "messages", "role", "content", fixed=(("system", "system"),)),
    Layout("conversations", "conversations", "from", "value"),
    Layout("system_conversations", "conversations", "from", "value", fixed=(("system", "system"),)),
    Layout("prompt_response", fixed=((_ASK, "prompt"), (ASSISTANT, "response"))),
    Layout("prompt_input_response", fixed=((_ASK, "prompt"), (_ASK, "input"), (ASSISTANT, "response"))),
    Layout("prompt_completion", fixed=((_ASK, "prompt"), (ASSISTANT, "completion"))),
    Layout("system_prompt_response", fixed=(("system", "system"), (_ASK, "prompt"), (ASSISTANT, "response"))),
    Layout("instruction", fixed=((_ASK, "instruction"), (ASSISTANT, "output"))),
    Layout("instruction_input", fixed=((_ASK, "instruction"), (_ASK, "input"), (ASSISTANT, "output"))),
    Layout("instruction_response", fixed=((_ASK, "instruction"), (ASSISTANT, "response"))),
    Layout("question_answer", fixed=((_ASK, "question"), (ASSISTANT, "answer"))),
)


def fingerprint(record: Column, paths: list[str]) -> Column:
    """Hash of those of the field paths that occur in the record, a null value included."""
    seen = [F.when(F.try_variant_get(record, f"$.{p}", "variant").isNotNull(), F.lit(p)) for p in sorted(paths)]
    return F.md5(F.concat_ws(",", *seen))


def unmapped_records(turns: DataFrame) -> DataFrame:
    """One row: how many records of `canonical_turns` no mapping has."""
    return turns.agg(F.count_if(F.col("layout").isNull()).alias("unmapped"))


def canonical_turns(
    records: DataFrame, record: Column, conversation: Column, order: Column, layouts: tuple[Layout, ...] = LAYOUTS,
) -> DataFrame:
    """(conv_id, part, place, layout, role, text): one row per turn, `part` and `place` give the order.

    A record may have further fields: a mapping fits if the hash of its paths that occur is its fingerprint, and the one
    with most paths is taken, one with a list of turns before all others. A record that no mapping fits gives one row with a null layout, role and text, so that
    nothing vanishes unseen. Null texts and roles become empty. Every map-side step is one record at a time.
    """
    def mapped(found: Column) -> Column:
        name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role: string, text: string>>")
        # the last test decides first: lists of turns, then more paths, then earlier in the list of layouts
        for layout in sorted(reversed(layouts), key=lambda x: (x.items is not None, len(x.paths))):
            fits = fingerprint(found, layout.paths) == layout.fingerprint
            name = F.when(fits, layout.name).otherwise(name)
            turns = F.when(fits, layout.turns(found)).otherwise(turns)
        return F.struct(name.alias("layout"), turns.alias("turns"))

    # the record is computed once, however many mappings ask for it
    chosen = let(record, mapped)
    rows = records.select(conversation.alias("conv_id"), order.alias("part"), chosen.alias("chosen"))
    return rows.select("conv_id", "part", "chosen.layout", F.posexplode_outer("chosen.turns").alias("place", "turn")).select(
        "conv_id", "part", "place", "layout", "turn.role", "turn.text")


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask.

    loss_mask: (segment, start, length) of each assistant turn's text within its segment, the run of characters up
    to and with the end mark; all else is outside the loss. Turns are escaped and marked before the shuffle; one
    conversation is one text, so it must fit a task. Turns with equal order are put in order of role and text. A
    null conversation id is a conversation of its own. Unmapped records are left to the caller.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    marked = turns.where(F.col("layout").isNotNull()).select(
        "conv_id", "part", "place", role.alias("role"), head.alias("head"), escape(F.coalesce(F.col("text"), F.lit(""))).alias("body"))
    # in order of: part, place, role, then the text
    segment = F.struct("part", "place", "role", F.concat("head", "body", F.lit(END + "\n")).alias("segment"),
                       F.length("head").alias("start"), F.length("body").alias("length"))
    whole = marked.groupBy("conv_id").agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    mask = F.filter(
        F.transform("segments", lambda s, i: F.when(
            s["role"] == ASSISTANT, F.struct(i.alias("segment"), s["start"].alias("start"), s["length"].alias("length")))),
        lambda m: m.isNotNull())
    return whole.select("conv_id", F.array_join(F.col("segments.segment"), "").alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text, segment>> of a formatted conversation."""
    segments = F.filter(F.split(formatted, r"(?<=<\|im_end\|>\n)", -1), lambda s: s != "")

    def turn(segment: Column) -> Column:
        inner = F.substring(segment, F.lit(len(START) + 1), F.length(segment) - len(START) - len(END) - 1)
        role = F.substring_index(inner, "\n", 1)
        return F.struct(
            unescape(F.replace(role, F.lit(LINE), F.lit("\n"))).alias("role"),
            unescape(F.substring(inner, F.length(role) + 2, F.length(inner))).alias("text"), segment.alias("segment"))

    return F.transform(segments, turn)


def loss_text(turns: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, one behind the other."""
    return F.array_join(F.transform(mask, lambda m: unescape(
        F.substring(F.get(turns, m["segment"])["segment"], m["start"] + 1, m["length"]))), "")


def oracle(probe: str) -> str:
    """DuckDB: what reading back must give, from the rows themselves; the length from the same escaping."""
    def escaped(text: str) -> str:
        return f"regexp_replace({text}, '{_ESCAPE}', '\\1\\4\\\\\\2\\5\\3\\6', 'g')"

    marks = len(START) + len(END) + 2
    return f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS given, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{probe}'), (-7, 1, 'assistant', '{probe}')),
rows AS (SELECT *, CASE WHEN given = 'human' THEN 'user' WHEN given IN ('gpt', 'bot', 'model') THEN '{ASSISTANT}' ELSE given END AS role FROM said),
sized AS (SELECT *, length({escaped('text')}) + length(replace({escaped('role')}, chr(10), '{LINE}')) + {marks} AS chars FROM rows),
whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = '{ASSISTANT}'), '') AS loss, sum(chars)::BIGINT AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole
"""
