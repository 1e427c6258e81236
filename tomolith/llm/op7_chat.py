"""Chat formatting: one rendered string per conversation, encoded with offsets, loss masks by binary search.

A turn is rendered as ``[TURN]role[/TURN]text</s>`` and a conversation begins with ``<s>``.
Control strings inside roles and texts are escaped reversibly: a backslash is doubled, and
one goes behind the first character of a control string, so that the tokenizer (which
knows the control strings as single tokens) cannot see them there. Control tokens are hard
borders for the tokenizer, so a conversation over ``PIECE_CHARS`` is encoded piece by
piece, cut at ends of turns, with the very ids of encoding it at once; memory stays bounded
by the longest turn. A token is under the loss mask if it lies inside the text of an
assistant turn: its span is found in the sorted turn spans by binary search.

Rows are ordered by turn, then role and text (null turns first). Null text or role: empty.
Rows with a null conversation id form one conversation. Repeated rows are repeated turns,
ties in turn are ordered by role and text. A turn of any length is encoded whole. An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
# The control strings of the template.
CONTROLS = ("<s>", "</s>", "[TURN]", "[/TURN]", "[INST]", "[/INST]")
PIECE_CHARS = 1 << 20

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"\[TURN\](.*?)\[/TURN\](.*?)</s>", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@lru_cache(maxsize=2)
def tokenizer(path: str):  # noqa: ANN201
    from tokenizers import AddedToken, Tokenizer
    from tokenizers.processors import ByteLevel

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROLS])
    t.post_processor = ByteLevel(trim_offsets=False)
    return t


def encoded(text: str, spans: np.ndarray, path: str) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Token ids, offsets (n x 2, characters) and the loss mask of a rendered piece."""
    got = tokenizer(path).encode(text, add_special_tokens=False)
    offsets = np.array(got.offsets, np.int64).reshape(-1, 2)
    at = np.searchsorted(spans[:, 0], offsets[:, 0], "right") - 1
    inside = (at >= 0) & (offsets[:, 1] > offsets[:, 0])
    if len(spans):
        inside &= offsets[:, 1] <= spans[np.maximum(at, 0), 1]
    return got.ids, offsets, inside


PIECE = "conv_id long, piece int, last boolean, text string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def formatted(turns: DataFrame, tokenizer_path: str = TOKENIZER, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Rendered conversations in order, as pieces: text, token ids, offsets and loss mask."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECE.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
        out: list[tuple] = []
        out_chars = 0

        def flush() -> pa.RecordBatch:
            nonlocal out, out_chars
            cols = list(zip(*out, strict=True))
            out, out_chars = [], 0
            flat = [pa.array(c, k) for c, k in zip(cols[:4], kinds, strict=False)]
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in c])), pa.int32()), pa.array(np.concatenate(c), k.value_type)) for c, k in zip(cols[4:], kinds[4:], strict=True)]
            return pa.RecordBatch.from_arrays([*flat, *lists], names)

        def piece(last: bool) -> None:
            nonlocal text, spans, chars, number, out_chars
            whole = "".join(text)
            ids, offsets, loss = encoded(whole, np.array(spans, np.int64).reshape(-1, 2), tokenizer_path)
            out.append((conv, number, last, whole, np.array(ids, np.int32), offsets[:, 0].astype(np.int32), offsets[:, 1].astype(np.int32), loss))
            out_chars += len(whole)
            text, spans, chars, number = [], [], 0, number + 1

        started, conv, number, text, spans, chars = False, None, 0, ["<s>"], [], 3
        for batch in batches:
            for id_, role, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or id_ != conv:
                    if started:
                        piece(True)
                    started, conv, number, text, spans, chars = True, id_, 0, ["<s>"], [], 3
                elif chars >= piece_chars:
                    piece(False)
                head, body = f"[TURN]{escape(role)}[/TURN]", escape(said)
                if role == "assistant":
                    spans.append((chars + len(head), chars + len(head) + len(body)))
                text += [head, body, "</s>"]
                chars += len(head) + len(body) + 4
                if out_chars >= piece_chars:
                    yield flush()
        if started:
            piece(True)
        if out:
            yield flush()

    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text"))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(work, PIECE)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def digests(pieces: DataFrame) -> DataFrame:
    """Reads conversations back from rendered pieces and their masks (in the order ``formatted`` gives)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = lambda: {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "tokens": 0, "masked": 0}
        state = fresh()
        for batch in batches:
            out = []
            scalar = [batch.column(k).to_pylist() for k in (0, 2, 3)]
            for i, (conv, last, text) in enumerate(zip(*scalar, strict=True)):
                starts, ends, loss = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (5, 6, 7))
                for role, said in _TURN.findall(text):
                    state["n"] += 1
                    state["turns"].update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                mask = loss.astype(bool)
                begin, end = starts[mask], ends[mask]
                if len(begin):
                    # Tokens of one character overlap, tokens of one turn touch: a gap starts a new turn.
                    cut = np.flatnonzero(begin[1:] > end[:-1]) + 1
                    for a, b in zip(begin[np.append(0, cut)], end[np.append(cut - 1, len(end) - 1)], strict=True):
                        said = unescape(text[a:b])
                        state["chars"] += len(said)
                        state["loss"].update(said.encode())
                state["all"] += len(text)
                state["tokens"] += len(starts)
                state["masked"] += int(mask.sum())
                if last:
                    out.append((conv, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"], state["tokens"], state["masked"]))
                    state = fresh()
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in DIGEST.split(", ")])

    return pieces.mapInArrow(work, DIGEST)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    out = digests(formatted(turns.unionByName(more)))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _escaped_length(column: str) -> str:
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return f"length({out})"


SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (3 + sum({_escaped_length("role")} + {_escaped_length("text")} + 17))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
