"""Chat formatting with typed content parts.

Each turn is a list of parts. A visitor flattens them in order: texts are escaped, attachments leave a placeholder and
are recorded with their reference and the tokens they expand to. Turns are formatted where they lie; a range partition
by conversation and turn then puts conversations together, and one that spans several tasks stays cut into pieces.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.session import cut_lineage

from .buffers import take

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<place:int,kind:string,ref:string,tokens:long>"

#: Characters of one written piece of a conversation, at least one turn.
PIECE_CHARS = 1 << 20

TURN, END = "<|turn|>", "<|end|>"

#: What follows < or [ in the control strings of this and other common templates.
_TAIL = r"(?=\||/?s>|/?INST\]|</?SYS>>)"
_CONTROL = re.compile(r"([<\[])(\\*)" + _TAIL)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _TAIL)
_HOLDER = re.compile(r"<\|(?:image|audio|document)\|>")
_TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    """Put one more backslash into every control string, so that none is left; reversed by :func:`unescape`."""
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


@dataclass
class PartVisitor:
    """Flattens the parts of one turn; an unknown kind counts as text, missing sizes as one token."""

    patch: int = 28
    audio_rate: float = 25.0
    page_tokens: int = 256
    out: list[str] = field(default_factory=list)
    size: int = 0
    texts: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple[int, str, str | None, int]] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['kind']}" if part["kind"] in ("image", "audio", "document") else "visit_text")(part)

    def visit_text(self, part: dict) -> None:
        text = escape(part["text"] or "")
        self.texts.append((self.size, self.size + len(text)))
        self._put(text)

    def visit_image(self, part: dict) -> None:
        self._attach(part, math.ceil((part["width"] or 1) / self.patch) * math.ceil((part["height"] or 1) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil((part["seconds"] or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part["pages"] or 1) * self.page_tokens)

    def _attach(self, part: dict, tokens: int) -> None:
        self.attachments.append((len(self.attachments), part["kind"], part["ref"], max(1, tokens)))
        self._put(f"<|{part['kind']}|>")

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)


def format_turn(role: str | None, parts: list[dict] | None) -> tuple[str, list[tuple[int, int]], list[tuple[int, str, str | None, int]]]:
    """The formatted turn, its loss spans in code points (assistant texts only) and its attachments."""
    head = TURN + escape((role or "").replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    visitor = PartVisitor(size=len(head))
    for part in parts or []:
        visitor.visit(part)
    loss = [s for s in visitor.texts if s[1] > s[0]] if role == "assistant" else []
    return head + "".join(visitor.out) + END + "\n", loss, visitor.attachments


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted piece; placeholders are left out of the text."""
    for found in _TURN.finditer(formatted):
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(found[1]))
        yield role, unescape(_HOLDER.sub("", found[2]))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"))).cast("array<struct<kind:string,text:string>>")


def typed_parts(rows: DataFrame) -> Column:
    """The column ``parts`` of ``rows`` as :data:`PART` values; fields that it lacks are null."""
    fields = {f.name for f in rows.schema["parts"].dataType.elementType.fields}
    wanted = [x.split(":") for x in PART[7:-1].split(",")]
    return F.transform("parts", lambda p: F.struct(*[(p[n] if n in fields else F.lit(None)).cast(t).alias(n) for n, t in wanted]))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formatted conversations, written to the shared folder and read back.

    ``turns`` has conv_id, turn, role and parts, a list of structs with kind, text, ref, width, height, seconds, pages
    (any of them may be missing). Rows of one conv_id follow each other by turn, then role and text, nulls first; rows
    with a null conv_id are one conversation, repeated rows stay, an empty table gives none. Returns (conv_id, part,
    piece, whole, n_turns, formatted, loss, attachments, n_attached): usually one row for each conversation; one that
    is longer than :data:`PIECE_CHARS` or that tasks share has several, in order of part and piece, with ``whole``
    false. ``loss`` holds spans of ``formatted`` in code points; n_attached is the tokens that placeholders expand to.
    """
    names = ["conv_id", "part", "piece", "whole", "n_turns", "formatted", "loss", "attachments", "n_attached"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    attached = pa.list_(pa.struct([("turn", pa.int64()), ("place", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", span), ("attachments", attached), ("n_attached", pa.int64())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        current, piece, opened = object(), 0, False
        text: list[str] = []
        loss: list[dict] = []
        files: list[dict] = []
        size = 0

        def flush(whole: bool) -> pa.RecordBatch:
            nonlocal piece, size
            row = [current, part, piece, whole, len(text), "".join(text), loss[:], files[:], sum(f["tokens"] for f in files)]
            out = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], names)
            text.clear(), loss.clear(), files.clear()
            piece, size = piece + 1, 0
            return out

        first = True
        for batch in batches:
            for conv, turn, role, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if opened and conv != current:
                    # The first conversation of a task may have begun in the one before.
                    yield flush(not first and piece == 0)
                    first, opened = False, False
                if not opened:
                    current, piece, opened = conv, 0, True
                elif size > PIECE_CHARS:
                    yield flush(False)
                formatted, spans, found = format_turn(role, parts)
                text.append(formatted)
                loss += [{"start": size + a, "end": size + b} for a, b in spans]
                files += [{"turn": turn, "place": p, "kind": k, "ref": r, "tokens": n} for p, k, r, n in found]
                size += len(formatted)
        if opened:
            yield flush(False)

    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", typed_parts(turns).alias("parts"))
    texts = F.transform("parts", lambda p: p["text"])
    keyed = plain.withColumn("tie", F.array_join(texts, "\n", ""))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(parts, "conv_id", "turn", "role", "tie").sortWithinPartitions("conv_id", "turn", "role", "tie").drop("tie")
    kinds = f"conv_id long, part int, piece long, whole boolean, n_turns long, formatted string, loss array<struct<start:long,end:long>>, attachments array<struct<turn:long,{ATTACHMENT[7:]}>, n_attached long"
    return cut_lineage(dealt.mapInArrow(work, kinds))


class _Digest:
    """What is read back of one conversation, piece by piece."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss, self.chars = conv, 0, 0, 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict]) -> None:
        for role, text in read_turns(formatted):
            self.turns += 1
            self.turns_hash.update(f"{role}\n{text}\n".encode())
        for span in loss:
            text = unescape(formatted[span["start"] : span["end"]])
            self.loss += len(text)
            self.loss_hash.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.turns, self.turns_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.chars


def read_back(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the formatted text.

    Whole conversations are read where they lie. Only those in several pieces are brought together, and streamed piece
    by piece, as a digest of a whole conversation must see its text in order.
    """
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [k.split()[0] for k in kinds.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Digest | None = None
        for batch in batches:
            done = []
            for conv, whole, formatted, loss in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or whole or state.conv != conv:
                    done += [state.row()] if state else []
                    state = _Digest(conv)
                state.add(formatted, loss)
            if done:
                yield rows(done)
        if state:
            yield rows([state.row()])

    columns = ["conv_id", "whole", "formatted", "loss"]
    shared = pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").select(columns)
    return pieces.where("whole").select(columns).mapInArrow(work, kinds).union(shared.mapInArrow(work, kinds))


def turns_of(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, parts) from rows of plain text; null text is empty."""
    plain = take(table, conv_id=conv_id, turn=turn, role=role, text=text)
    return plain.select("conv_id", "turn", "role", text_parts(F.coalesce("text", F.lit(""))).alias("parts"))
