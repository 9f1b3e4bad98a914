"""Transcript parsing: a hidden Markov model over speaker markers and line features recovers roles by Viterbi, then turns are
rendered in one canonical form.

A unit is a row's run of lines up to the next line that opens with a speaker marker. Units are put in order over range
partitions, so a conversation of any length lies in chunks of bounded size. Each chunk's edge pieces are summed up as a
matrix of best scores (state before to state at the end); the matrices of a conversation, a few numbers a chunk, fix the
states between its chunks, and then every chunk is decoded on its own. That is exact Viterbi.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import blank_null, parts, ship, staged, thinned

ROLES = ("system", "user", "assistant")
#: The model is fitted on so many labelled rows at most, of at most so many lines, chosen by a hash of conv_id and the block
#: of so many turns.
SAMPLE_ROWS, SAMPLE_LINES, SAMPLE_TURNS = 20_000, 200, 100
#: Units decoded together at most, and characters of their texts (or one unit).
CHUNK, CHUNK_CHARS = 20_000, 4_000_000

_MARKER = re.compile(r"\s*[#*\[<|]{0,3}(system|user|human|question|q|assistant|ai|bot|answer|a)[\]>|*]{0,3}\s*:\s*[*]{0,2}\s*", re.I)
_MARKED = {"system": 1, "user": 2, "human": 2, "question": 2, "q": 2, "assistant": 3, "ai": 3, "bot": 3, "answer": 3, "a": 3}
_LIST = re.compile(r"\s*(?:[-*•]|\d+[.)])\s")
#: Values of a line's features: marker, length, place in its unit, question, list item or code.
SIZES = (4, 5, 4, 2, 2)


def line_code(line: str, place: int) -> int:
    """A line's features as one number; place: 0 alone, 1 first, 2 later, 3 first of many."""
    found = _MARKER.match(line)
    n = len(line)
    values = (
        _MARKED[found[1].lower()] if found else 0,
        0 if not line.strip() else 1 if n < 60 else 2 if n < 160 else 3 if n < 500 else 4,
        place,
        int("?" in line),
        int(bool(_LIST.match(line)) or line.startswith("```")),
    )
    out = 0
    for v, size in zip(values, SIZES, strict=True):
        out = out * size + v
    return out


def units(text: str) -> list[tuple[str, list[int]]]:
    """(text without its marker, codes of its lines) of each unit of a row; an empty text is one empty unit."""
    runs: list[list[str]] = []
    for line in text.split("\n"):
        if not runs or _MARKER.match(line):
            runs.append([])
        runs[-1].append(line)
    out = []
    for run in runs:
        first = 0 if len(run) == 1 else 3 if len(run) > 4 else 1
        codes = [line_code(line, 2 if i else first) for i, line in enumerate(run)]
        found = _MARKER.match(run[0])
        out.append(("\n".join([run[0][found.end() :] if found else run[0], *run[1:]]), codes))
    return out


class Model:
    """start, step (before, after) and emission (code, role) as log probabilities."""

    def __init__(self, start: np.ndarray, step: np.ndarray, features: list[np.ndarray]):
        self.start, self.step = np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True))
        emission = np.zeros((1, len(ROLES)))
        for counts in features:
            p = np.log(counts / counts.sum(0, keepdims=True))
            emission = (emission[:, None, :] + p[None, :, :]).reshape(-1, len(ROLES))
        self.emission = emission

    def of(self, codes: list[int]) -> list[float]:
        return self.emission[codes].sum(0).tolist() if codes else [0.0] * len(ROLES)


def fit(rows: list[tuple]) -> Model:
    """From labelled units (conv_id, role, codes, joined) in order; not joined: what comes before it is not in the sample.
    Counts start at one; a marker counts strongly for its own role."""
    n = len(ROLES)
    start, step, features = np.ones(n), np.ones((n, n)), [np.ones((size, n)) for size in SIZES]
    for role, marked in enumerate((1, 2, 3)):
        features[0][marked, role] += 100
    before = {}
    for conv_id, role, codes, joined in rows:
        if role not in ROLES:
            before.pop(conv_id, None)
            continue
        r = ROLES.index(role)
        if not joined:
            pass
        elif conv_id in before:
            step[before[conv_id], r] += 1
        else:
            start[r] += 1
        before[conv_id] = r
        for code in codes:
            for k in range(len(SIZES) - 1, -1, -1):
                code, v = divmod(code, SIZES[k])
                features[k][v, r] += 1
    return Model(start, step, features)


def viterbi(scores: list[list[float]], start: list[float], step: list[list[float]], before: int | None, last: int | None) -> tuple[list[int], float]:
    """Best states of a piece, entered from state before (None: a conversation's start), ending in last (None: any)."""
    k = range(len(start))
    enter = start if before is None else step[before]
    at, back = [enter[j] + scores[0][j] for j in k], []
    for row in scores[1:]:
        best = [max(k, key=lambda i, j=j: at[i] + step[i][j]) for j in k]
        at = [at[best[j]] + step[best[j]][j] + row[j] for j in k]
        back.append(best)
    state = last if last is not None else max(k, key=at.__getitem__)
    score, path = at[state], [state]
    for best in reversed(back):
        path.append(best[path[-1]])
    return path[::-1], score


def transfer(scores: list[list[float]], step: list[list[float]], start: list[float]) -> list[float]:
    """Best scores of a piece by the state before it (the last row: a conversation's start) and at its end."""
    k = range(len(start))
    out: list[float] = []
    for enter in [*step, start]:
        at = [enter[j] + scores[0][j] for j in k]
        for row in scores[1:]:
            at = [max(at[i] + step[i][j] for i in k) + row[j] for j in k]
        out += at
    return out


def boundaries(pieces: list[tuple[int, list[float]]]) -> list[tuple[int, int | None, int]]:
    """(chunk, state before, state at the end) of a conversation's pieces, from their matrices in order."""
    n = len(ROLES)
    k = range(n)
    at, back = pieces[0][1][n * n :], []
    for _, m in pieces[1:]:
        best = [max(k, key=lambda i, j=j: at[i] + m[i * n + j]) for j in k]
        at = [at[best[j]] + m[best[j] * n + j] for j in k]
        back.append(best)
    ends = [max(k, key=at.__getitem__)]
    for best in reversed(back):
        ends.append(best[ends[-1]])
    ends.reverse()
    return [(chunk, ends[i - 1] if i else None, ends[i]) for i, (chunk, _) in enumerate(pieces)]


def render(role: str, text: str) -> str:
    """One turn in canonical form; control marks within the text are broken up."""
    return f"<|{role}|>\n{text.strip().replace('<|', '< |')}\n<|end|>\n"


_UNIT = "chunk long, pos long, conv_id long, turn long, segment int, role string, text string, codes array<int>"


def split_units(conversations: DataFrame) -> DataFrame:
    """Units of all rows in order of conv_id, turn (null first), dealt into chunks."""
    ship(conversations.sparkSession)

    def run(batches):
        part, pos, chunk, held, chars = TaskContext.get().partitionId(), 0, 0, 0, 0
        for batch in batches:
            rows = []
            for conv_id, turn, role, text in zip(*[batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text")], strict=True):
                for segment, (own, codes) in enumerate(units(text)):
                    if held and (held >= CHUNK or chars + len(own) > CHUNK_CHARS):
                        chunk, held, chars = chunk + 1, 0, 0
                    rows.append(((part << 32) + chunk, pos, conv_id, turn, segment, role, own, codes))
                    pos, held, chars = pos + 1, held + 1, chars + len(own)
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _UNIT.split(", ")])

    own = conversations.select("conv_id", "turn", "role", blank_null("text").alias("text"), F.monotonically_increasing_id().alias("tie"))
    keys = (F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("tie"))
    n = parts(conversations.sparkSession)
    return own.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, _UNIT)


def train(own: DataFrame) -> Model:
    """Fits on a bounded sample of units whose role is given; segments after a marker inside a row are left out.

    The sample has SAMPLE_ROWS units wherever there are as many: if the blocks that the hash picks hold fewer, more are picked.
    """
    usable = F.col("role").isin(*ROLES) & (F.col("segment") == 0) & (F.size("codes") <= SAMPLE_LINES)
    labelled = own.where(usable).select("conv_id", F.floor(F.col("turn") / SAMPLE_TURNS).alias("block"), "chunk", "pos", "role", "codes")
    total = share = labelled.count()
    while True:
        some = thinned(labelled, share, SAMPLE_ROWS, "conv_id", "block")
        rows = some.orderBy(F.xxhash64("conv_id", "block"), "conv_id", "block", "chunk", "pos").limit(SAMPLE_ROWS).collect()
        if len(rows) == min(total, SAMPLE_ROWS):
            break
        share //= 2
    rows.sort(key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.chunk, r.pos))
    if len(rows) == total:
        return fit([(r.conv_id, r.role, r.codes, True) for r in rows])
    # null turns come first
    least = F.min(F.struct(F.col("block").isNotNull(), "block"))["block"].alias("block")
    convs = own.sparkSession.createDataFrame([(c,) for c in {r.conv_id for r in rows}], "picked long")
    heads = labelled.join(F.broadcast(convs), F.col("conv_id").eqNullSafe(F.col("picked")), "left_semi").groupBy("conv_id").agg(least)
    head = {r.conv_id: r.block for r in heads.collect()}  # at most SAMPLE_ROWS conversations
    out, last = [], {}
    for r in rows:
        before = last.get(r.conv_id, ())
        joined = r.block == head[r.conv_id] if before == () else r.block == before or (None not in (r.block, before) and r.block == before + 1)
        out.append((r.conv_id, r.role, r.codes, joined))
        last[r.conv_id] = r.block
    return fit(out)


def recover(conversations: DataFrame, model: Model | None = None) -> DataFrame:
    """Roles and canonical text of all turns.

    conversations: conv_id, turn, role, text; role may be null or wrong, it serves for fitting alone. One row a unit:
    conv_id, turn, segment (from 0 in its row), role (as given), role_found, rendered. A null or empty text is one empty
    unit. Rows with a null conv_id are one conversation; null turns come first; rows with equal turns stand in any order.
    Other columns are ignored; an empty table gives no row.
    """
    own = staged(split_units(conversations), "units")
    model = model or train(own)
    start, step = model.start.tolist(), model.step.tolist()

    def pieces(table: pa.Table) -> tuple[pa.Table, dict]:
        table = table.sort_by("pos")
        out: dict = {}
        for i, c in enumerate(table["conv_id"].to_pylist()):
            out.setdefault(c, []).append(i)
        return table, out

    def matrices(table: pa.Table) -> pa.Table:
        table, by_conv = pieces(table)
        codes, chunk, rows = table["codes"], table["chunk"][0].as_py(), []
        edges = dict.fromkeys((table["conv_id"][0].as_py(), table["conv_id"][-1].as_py()))
        for c in edges:
            scores = [model.of(codes[i].as_py()) for i in by_conv[c]]
            rows.append((c, chunk, transfer(scores, step, start)))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.float64())), strict=True)], names=["conv_id", "chunk", "m"])

    def fixed(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["chunk"].to_pylist(), table["m"].to_pylist(), strict=True))
        conv_id, out = table["conv_id"][0].as_py(), boundaries(rows)
        return pa.table([pa.array([conv_id] * len(out), pa.int64()), *[pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)]], names=["conv_id", "chunk", "before", "last"])

    def decode(table: pa.Table, edges: pa.Table) -> pa.Table:
        names = ["conv_id", "turn", "segment", "role", "role_found", "rendered"]
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())], names=names)
        table, by_conv = pieces(table)
        given = {c: (b, e) for c, b, e in zip(*[edges[x].to_pylist() for x in ("conv_id", "before", "last")], strict=True)}
        codes, texts, found = table["codes"].to_pylist(), table["text"].to_pylist(), [""] * table.num_rows
        for c, at in by_conv.items():
            path, _ = viterbi([model.of(codes[i]) for i in at], start, step, *given.get(c, (None, None)))
            for i, state in zip(at, path, strict=True):
                found[i] = ROLES[state]
        rendered = [render(r, t) for r, t in zip(found, texts, strict=True)]
        return pa.table([*[table[c] for c in names[:4]], pa.array(found, pa.string()), pa.array(rendered, pa.string())], names=names)

    edges = own.groupBy("chunk").applyInArrow(matrices, "conv_id long, chunk long, m array<double>")
    states = edges.groupBy("conv_id").applyInArrow(fixed, "conv_id long, chunk long, before int, last int")
    return own.groupBy("chunk").cogroup(states.groupBy("chunk")).applyInArrow(decode, "conv_id long, turn long, segment int, role string, role_found string, rendered string")
