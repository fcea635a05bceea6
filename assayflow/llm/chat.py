"""Chat formatting in budgeted, turn-aligned windows.

Rows of a conversation stream through one task in turn order (a shuffle by conversation, sorted
within partitions), so a conversation of any length takes the memory of one window. The running
prefix sum of turn tokens decides how far a window reaches. Every window opens with the
conversation's first turn if that is a system turn, then repeats the last turns of the window
before, within a budget of their own; repeated turns carry no loss, so each assistant text is a
target once. Tokens are those of a turn as it is written, marks and escapes included: counted by a
tokenizer model (op6's search), or bounded by the number of bytes where none is given. A line end
closes every turn and no piece goes beyond one, so a window has no more tokens than its turns.

Template: <|turn|>role, newline, text, <|end|>, newline. In texts a backslash is doubled, and a
backslash is put behind the first character of anything that opens a control string of this or of
other common templates; unescape() undoes both exactly.

Defined cases: null text and null role are empty; rows of equal turn are ordered by role, then
text, and repeated rows all stay; rows of null conversation form one conversation; a turn over the
budget has a window of its own, whole, and a very long text stays one turn; empty table, empty result;
further columns are ignored. A conversation's digest is sequential, so it is read by one task, in the
memory of one window.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, rows_of, ship
from .spm import Pieces, encode, tables_for

OPEN, END = "<|turn|>", "<|end|>\n"
# Control strings of common templates, which texts may not spell.
_CONTROL = re.compile(r"(<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=/?INST\]))")
_ESCAPED = re.compile(r"\\(\\|n)?")
_TURN = re.compile(r"<\|turn\|>(.*?)\n(.*?)<\|end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"\\": "\\", "n": "\n", None: ""}[m[1]], text)


def most_tokens(text: str) -> int:
    """Tokens of any tokenizer whose pieces have a byte at least, and a mark before the text."""
    return len(text.encode("utf-8", "surrogatepass")) + 1


@dataclass(frozen=True)
class ChatWindows:
    """max_tokens: of a window. history_turns, history_tokens: what a window repeats at most of the
    one before. targets: the role whose texts are learned."""

    max_tokens: int = 1024
    history_turns: int = 2
    history_tokens: int = 256
    target: str = "assistant"


@dataclass
class _Turn:
    role: str
    head: str
    body: str  # the escaped text
    tokens: int
    before: int  # prefix sum of the tokens of earlier turns


@dataclass
class Conversation:
    """Takes turns in order; gives windows as tuples of WINDOWS without conv_id."""

    rules: ChatWindows
    tokens_of: Callable[[str], int] = most_tokens
    system: _Turn | None = None
    total: int = 0  # prefix sum over all turns so far
    count: int = 0
    window: int = 0
    repeated: list[_Turn] = field(default_factory=list)
    new: list[_Turn] = field(default_factory=list)
    last: deque = field(default_factory=deque)

    def add(self, role: str, text: str) -> Iterator[tuple]:
        head, body = f"{OPEN}{escape(role).replace('\n', '\\n')}\n", escape(text)
        turn = _Turn(role, head, body, self.tokens_of(head + body + END), self.total)
        self.total += turn.tokens
        if self.new and self.total - self.new[0].before + sum(t.tokens for t in self.repeated) > self.rules.max_tokens:
            yield self.close()
            room = self.rules.max_tokens - turn.tokens - (self.system.tokens if self.system else 0)
            room = min(room, self.rules.history_tokens)
            history: list[_Turn] = []
            for t in reversed(self.last):
                if t is self.system or t.tokens > room:
                    break
                history.insert(0, t)
                room -= t.tokens
            self.repeated = [self.system] * bool(self.system) + history
        if not self.count and role == "system":
            self.system = turn
        self.count += 1
        self.new.append(turn)
        self.last.append(turn)
        if len(self.last) > self.rules.history_turns:
            self.last.popleft()

    def close(self) -> tuple:
        parts, loss, at = [], [], 0
        for k, t in enumerate([*self.repeated, *self.new]):
            if k >= len(self.repeated) and t.role == self.rules.target:
                loss.append({"start": at + len(t.head), "end": at + len(t.head) + len(t.body)})
            parts.append(t.head + t.body + END)
            at += len(parts[-1])
        tokens = sum(t.tokens for t in self.repeated) + self.total_new()
        out = (self.window, len(self.repeated), len(self.new), tokens, "".join(parts), loss)
        self.window += 1
        self.new, self.repeated = [], []
        return out

    def total_new(self) -> int:
        return self.new[-1].before + self.new[-1].tokens - self.new[0].before


WINDOWS = (
    "conv_id {id}, window bigint, n_repeated bigint, n_new bigint, tokens bigint, formatted string, "
    "loss array<struct<start:int,end:int>>"
)


def counter(pieces: Pieces) -> Callable[[str], int]:
    tables = tables_for(pieces)
    return lambda text: len(encode(tables, text))


def format_chats(
    rows: DataFrame, rules: ChatWindows = ChatWindows(), conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text", pieces: Pieces | None = None,
) -> DataFrame:
    """WINDOWS of all conversations; a conversation's windows are neighbours, in order. pieces: the tokenizer
    model that counts tokens (about 1 MB, broadcast); none: most_tokens."""
    from pyspark.sql.pandas.types import to_arrow_type

    src = keyed(rows, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    kind = src.schema["conv_id"].dataType
    schema = pa.schema(
        [("conv_id", to_arrow_type(kind)), *[(x, pa.int64()) for x in ("window", "n_repeated", "n_new", "tokens")],
         ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
    )
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(pieces) if pieces else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared.value) if shared else most_tokens
        out: list[tuple] = []
        size = 0
        now: Conversation | None = None
        conv = None

        def flush() -> pa.RecordBatch:
            nonlocal size
            cols = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
            out.clear()
            size = 0
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for batch in batches:
            for ids, _, roles, texts in rows_of(batch):
                for i, role, text in zip(ids, roles, texts, strict=True):
                    if now is None or i != conv:
                        if now and now.new:
                            out.append((conv, *now.close()))
                        conv, now = i, Conversation(rules, count)
                    for w in now.add(role or "", text or ""):
                        out.append((conv, *w))
                        size += len(w[4])
                    if size > 4 << 20 or len(out) >= 1000:
                        yield flush()
        if now and now.new:
            out.append((conv, *now.close()))
        if out:
            yield flush()

    ordered = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, WINDOWS.format(id=kind.simpleString()))


def read_window(formatted: str, n_repeated: int) -> list[tuple[str, str]]:
    """(role, text) of a window's new turns."""
    turns = _TURN.findall(formatted)
    if sum(len(r) + len(t) + len(OPEN) + len(END) + 1 for r, t in turns) != len(formatted):
        raise ValueError("damaged window")
    return [(unescape(r), unescape(t)) for r, t in turns[n_repeated:]]


DIGESTS = (
    "conv_id {id}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint, n_windows bigint"
)


def read_back(windows: DataFrame) -> DataFrame:
    """DIGESTS of each conversation, from the formatted text and the loss spans alone, whatever the order of
    the rows: a shuffle by conversation puts its windows in order."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = windows.schema["conv_id"].dataType
    schema = pa.schema(
        [("conv_id", to_arrow_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
         ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())]
    )
    ship(windows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def give(rows: list[tuple]) -> pa.RecordBatch:
            done = [(c, n, a.hexdigest(), k, b.hexdigest(), f, w) for c, n, a, k, b, f, w in rows]
            cols = [pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)]
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for batch in batches:
            out = []
            for ids, repeated, texts, losses in rows_of(batch, 128):
                for i, n, text, loss in zip(ids, repeated, texts, losses, strict=True):
                    if state is None or i != conv:
                        if state:
                            out.append((conv, *state))
                        conv, state = i, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    for role, said in read_window(text, n):
                        state[0] += 1
                        state[1].update(f"{role}\n{said}\n".encode())
                    for span in loss:
                        said = unescape(text[span["start"] : span["end"]])
                        state[2] += len(said)
                        state[3].update(said.encode())
                    state[4] += len(text)
                    state[5] += 1
            if out:
                yield give(out)
        if state:
            yield give([(conv, *state)])

    src = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").select("conv_id", "n_repeated", "formatted", "loss")
    return src.mapInArrow(run, DIGESTS.format(id=kind.simpleString()))
