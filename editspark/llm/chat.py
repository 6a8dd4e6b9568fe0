r"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example's text is all turns before, as context, and then that one reply; only the reply's text is trainable, and its place
is given as a span of code points. A conversation that doesn't end with an assistant turn also yields its whole text as an example
without a trainable span, so that no turn is lost.

The template writes a turn as ``<turn role="ROLE">TEXT</turn>`` and a line end. Within texts and roles, a backslash, ``<`` and
``"`` are written ``\\``, ``\l`` and ``\q``; so ``<`` occurs in markers only, whatever texts say, and undoing the escapes gives the very text back.

Defined results: null texts and roles are empty; rows are ordered by turn (nulls first), then role, then text, and repeated
rows are turns of their own; rows without a ``conv_id`` are one conversation; a very long text is one turn like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import from_rows

TRAINED = "assistant"
_ESCAPES = {"\\": "\\\\", "<": "\\l", '"': "\\q"}
_TABLE = str.maketrans(_ESCAPES)
_BACK = {v: k for k, v in _ESCAPES.items()}
_ESCAPED = re.compile(r"\\[\\lq]")
_TURN = re.compile(r'<turn role="([^"<]*)">([^<]*)</turn>\n')
EXAMPLES = "conv_id long, turns long, text string, loss_start long, loss_end long, last boolean"
#: Code points of formatted text in a batch, about.
BATCH_CHARS = 4_000_000


def escape(text: str) -> str:
    return text.translate(_TABLE)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[0]], text)


def opening(role: str) -> str:
    return f'<turn role="{escape(role)}">'


CLOSING = "</turn>\n"


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; raises if there is anything else in it."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"not a formatted turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def expand(conversations: DataFrame) -> DataFrame:
    """Examples: ``conv_id``, ``turns`` in the text, ``text``, the trainable span (empty where there is none) and whether it is the conversation's ``last``.

    Conversations are dealt by id and stream through sorted, so that a task holds the text of one conversation at most.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)

        out, chars = [], 0
        here, context, n, waiting = object(), "", 0, None
        for conv, role, text in turns():
            if conv != here:
                if waiting or n:
                    out.append(waiting or (here, n, context, 0, 0, True))
                here, context, n, waiting = conv, "", 0, None
            if waiting:
                out.append((*waiting[:5], False))
                waiting = None
            start = len(context) + len(opening(role))
            body = escape(text)
            context += opening(role) + body + CLOSING
            n += 1
            chars += len(context)
            if role == TRAINED:
                waiting = (here, n, context, start, start + len(body), True)
            if chars > BATCH_CHARS:
                yield from_rows(EXAMPLES, out)
                out, chars = [], 0
        if waiting or n:
            out.append(waiting or (here, n, context, 0, 0, True))
        yield from_rows(EXAMPLES, out)

    return rows.mapInArrow(run, EXAMPLES)


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation, from the text and spans of ``expand``'s rows in its order.

    The last example of a conversation has all its turns; the trainable texts come one from each example; ``formatted_chars`` counts the
    code points of all its examples. Raises if the rows aren't in that order: if another conversation begins before one's last example, or examples don't grow.
    """
    spec = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, loss_chars, chars, n = hashlib.sha256(), 0, 0, 0
        here, before = None, 0
        for b in batches:
            out = []
            for conv, n_turns, text, start, end, last in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turns", "text", "loss_start", "loss_end", "last")), strict=True):
                if n and (conv != here or n_turns <= before):
                    raise ValueError(f"examples out of order: {conv} with {n_turns} turns after {here} with {before}")
                here, before = conv, n_turns
                trained = unescape(text[start:end])
                loss.update(trained.encode("utf-8", "surrogatepass"))
                loss_chars += len(trained)
                chars += len(text)
                n += 1
                if last:
                    turns = parse(text)
                    said = "".join(f"{role}\n{t}\n" for role, t in turns)
                    out.append((conv, len(turns), hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest(), loss_chars, loss.hexdigest(), chars, n))
                    loss, loss_chars, chars, n = hashlib.sha256(), 0, 0, 0
            yield from_rows(spec, out)
        if n:
            raise ValueError(f"the last example of {here} is missing")

    return examples.mapInArrow(run, spec)


def sql(extra: str) -> str:
    """DuckDB SQL for ``read_back(expand(...))`` over the table ``conversations`` and the rows ``extra``, ``(conv_id, turn, role, text), ...``."""
    fixed = len(opening("") + CLOSING)
    width = lambda x: f"length({x}) + length(regexp_replace({x}, '[^\\\\<\"]', '', 'g'))"
    return f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES {extra}) AS v(conv_id, turn, role, text)),
placed AS (SELECT *, row_number() OVER w AS nr, count(*) OVER (PARTITION BY conv_id) AS n, sum({fixed} + {width('role')} + {width('text')}) OVER w AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nr)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{TRAINED}'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY nr) FILTER (role = '{TRAINED}'), '')) AS loss_sha256,
  (sum(chars) FILTER (role = '{TRAINED}' OR nr = n))::BIGINT AS formatted_chars, count(*) FILTER (role = '{TRAINED}' OR nr = n) AS n_examples
FROM placed GROUP BY conv_id"""
