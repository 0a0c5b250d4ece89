"""Roles in plain transcripts by a hidden Markov model, and canonical rendering of the turns.

The lines of a transcript are the observations; a state is a role with the place of the line in its
turn (first or later). What is observed of a line: which role a speaker marker at its start names, if
any, whether a blank line stands before it, its length class, whether it asks. Start, transition and
emission probabilities are counted, with add-one smoothing, on a bounded sample of transcripts with
known roles; Viterbi then finds the likeliest states, so that turns whose marker is missing, or that
quote one, get their role from what stands around them.

Null and empty transcripts have no turns. Lines before the first turn belong to it. Roles other than
system, user and assistant count as user, null roles too; null texts count as empty. Turns of the
same number are ordered by role and text; each turn with a null key is a transcript of its own. No
conversation is gathered whole however long it is: pieces of PIECE turn numbers are parsed each with
the LEAD turns before and after it, so that the path through a piece is that through the whole, and
report their own turns only. Texts of any length are taken whole; of further columns `parse` carries
all, whatever their names, and replaces those it adds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import light, text_strings

ROLES = ("system", "user", "assistant")
STATES = [(role, first) for role in ROLES for first in (True, False)]
PIECE, LEAD, SAMPLE = 256, 16, 500
NAMES = {
    "system": "system|instructions?|context",
    "user": "user|human|customer|q|question|prompt|you",
    "assistant": "assistant|ai|bot|model|a|answer|response|gpt",
}
MARKER = re.compile(
    r"\s*(?:#{1,4}\s*)?(?:<\|?|\[|\*\*|\()?\s*(?:"
    + "|".join(f"(?P<{role}>{names})" for role, names in NAMES.items())
    + r")\s*(?P<end>:\s*\*\*|\*\*\s*:|\|>|>|\]\s*:?|\)\s*:|:)\s*",
    re.IGNORECASE,
)
SYMBOLS = 4 * 2 * 3 * 2 + 1
#: How the query writes its transcripts: before each role's text.
STYLES = ("{Role}: ", "### {Role}:\n", "<|{role}|>\n", "[{ROLE}] ", "{alt}: ", "**{Role}:** ")
ALTERNATIVES = {"system": "Context", "user": "Human", "assistant": "AI"}


def marker(line: str) -> tuple[int, str]:
    """0 and the line, or the number of the role its marker names (from 1) and what follows it."""
    m = MARKER.match(line)
    if not m:
        return 0, line
    return 1 + next(i for i, role in enumerate(ROLES) if m[role]), line[m.end() :]


def observe(lines: list[str]) -> np.ndarray:
    """The symbol of each line."""
    out, blank = np.empty(len(lines), np.int64), False
    for i, line in enumerate(lines):
        if not line.strip():
            out[i], blank = SYMBOLS - 1, True
            continue
        role, rest = marker(line)
        size = 0 if len(rest) < 40 else 1 if len(rest) < 160 else 2
        out[i] = ((role * 2 + blank) * 3 + size) * 2 + rest.rstrip().endswith("?")
        blank = False
    return out


def train(transcripts: Iterator[tuple[list[str], list[int]]]) -> dict[str, np.ndarray]:
    """Log probabilities from lines and the states they are in."""
    start, move, emit = np.ones(6), np.full((6, 6), 0.1), np.full((6, SYMBOLS), 0.05)
    for lines, states in transcripts:
        if not lines:
            continue
        s = np.array(states)
        start[s[0]] += 1
        np.add.at(move, (s[:-1], s[1:]), 1)
        np.add.at(emit, (s, observe(lines)), 1)
    # a turn's later lines follow its own lines only
    for i, (role, _) in enumerate(STATES):
        for j, (other, first) in enumerate(STATES):
            if not first and role != other:
                move[i, j] = 1e-9
    start[[j for j, (_, first) in enumerate(STATES) if not first]] = 1e-9
    return {"start": np.log(start / start.sum()), "move": np.log(move / move.sum(axis=1, keepdims=True)), "emit": np.log(emit / emit.sum(axis=1, keepdims=True))}


def viterbi(model: dict[str, np.ndarray], symbols: np.ndarray) -> list[int]:
    """The likeliest states; of equal ones the first."""
    if not len(symbols):
        return []
    emit, move = model["emit"][:, symbols].T, model["move"]
    score = model["start"] + emit[0]
    back = np.empty((len(symbols), 6), np.int64)
    for t in range(1, len(symbols)):
        through = score[:, None] + move
        back[t] = through.argmax(axis=0)
        score = through[back[t], np.arange(6)] + emit[t]
    path = [int(score.argmax())]
    for t in range(len(symbols) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return path[::-1]


def turns(model: dict[str, np.ndarray], transcript: str) -> list[tuple[str, str]]:
    """Role and text of each turn."""
    lines = transcript.split("\n") if transcript else []
    return joined(lines, viterbi(model, observe(lines)))


def joined(lines: list[str], path: list[int]) -> list[tuple[str, str]]:
    """Role and text of the turns that lines with these states make up."""
    out: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, path):
        role, first = STATES[state]
        if first or not out:
            named, rest = marker(line)
            out.append((role, [rest] if named and (rest.strip() or named) else [line]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(x).strip()) for role, x in out]


def render(found: list[tuple[str, str]]) -> str:
    """The canonical form: a role line before each text, an end mark after it."""
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in found)


# ---- transcripts of a table of turns


def role_number(role: str | None) -> int:
    return ROLES.index(role) if role in ROLES else 1


def written(key: int | None, said: list[dict]) -> tuple[list[str], list[int]]:
    """Lines and states of a transcript in the style that its key picks; every eighth turn lacks its marker."""
    from zlib import crc32

    style = STYLES[crc32(str(key).encode()) % len(STYLES)]
    lines, states = [], []
    for s in said:
        i = role_number(s["role"])
        role = ROLES[i]
        head = style.format(role=role, Role=role.capitalize(), ROLE=role.upper(), alt=ALTERNATIVES[role])
        if lines and crc32(f"{key}/{s['turn']}".encode()) % 8 == 0:
            head = ""
        own = (head + (s["text"] or "")).split("\n") + [""]
        lines += own
        states += [2 * i] + [2 * i + 1] * (len(own) - 1)
    return lines, states


def pieces(turns_table: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, piece and `said`, the ordered turns of each transcript; those with `own` false belong to its neighbours."""
    number = F.coalesce(F.col(turn).cast("long"), F.lit(0))
    rows = turns_table.select(
        F.col(key).alias("conv_id"), number.alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    near = F.array_distinct(F.transform(F.array(F.lit(0), F.lit(LEAD), F.lit(-LEAD)), lambda d: F.floor((F.col("turn") + d) / PIECE)))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text", F.monotonically_increasing_id())).otherwise(0)
    rows = rows.withColumn("home", F.floor(F.col("turn") / PIECE)).withColumn("alone", alone)
    rows = rows.withColumn("piece", F.explode(F.when(F.col("conv_id").isNull(), F.array("home")).otherwise(near)))
    said = F.struct("turn", "role", "text", (F.col("piece") == F.col("home")).alias("own"))
    found = rows.groupBy("conv_id", "piece", "alone").agg(F.sort_array(F.collect_list(said)).alias("said"))
    return found.filter(F.exists("said", lambda s: s["own"])).drop("alone")


def fit(table: DataFrame) -> dict[str, np.ndarray]:
    """Trains on the SAMPLE transcripts (from `pieces`) of the smallest hash."""
    got = table.filter("conv_id is not null").orderBy(F.xxhash64("conv_id", "piece"), "conv_id", "piece").limit(SAMPLE).collect()
    return train(written(r["conv_id"], [s for s in r["said"] if s["own"]]) for r in got)


def parse(df: DataFrame, model: dict[str, np.ndarray], transcript: str = "transcript") -> DataFrame:
    """Adds `turns` (array of role and text) and `rendered`; columns of these names are replaced."""
    keep = [c for c in df.columns if c not in ("turns", "rendered")]
    one = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("turns", T.ArrayType(one)), T.StructField("rendered", T.StringType())])
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [turns(model, t) for t in text_strings(batch.column(transcript))]
            rows = [[{"role": r, "text": x} for r, x in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(rows, kind), pa.array([render(f) for f in found])], [*keep, "turns", "rendered"]
            )

    return df.mapInArrow(light(run), schema)


def recovered(table: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """Writes each transcript as plain text, parses it and compares the roles line by line, in its own turns.

    conv_id, piece, n_turns (of the table), n_lines, n_right (lines with the right role), n_found
    (turns found), roles (theirs, in order), rendered_sha256 (of the canonical form).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, said in zip(batch.column("conv_id").to_pylist(), batch.column("said").to_pylist()):
                own = [s["own"] for s in said]
                # lines before, in and after its own turns; a turn without a marker has one only after other lines
                before, after = own.index(True), len(own) - own[::-1].index(True)
                lines, states = written(key, said[:after])
                to = len(lines)
                skip = len(written(key, said[:before])[0])
                lines, states = written(key, said)
                path = viterbi(model, observe(lines))
                right = sum(a // 2 == b // 2 for a, b in zip(states[skip:to], path[skip:to]))
                found = joined(lines[skip:to], path[skip:to])
                lines = lines[skip:to]
                out.append((sum(own), len(lines), right, len(found), ",".join(r for r, _ in found), sha256(render(found).encode()).hexdigest()))
            names = ["n_turns", "n_lines", "n_right", "n_found", "roles", "rendered_sha256"]
            columns = [pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(zip(*out))]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("piece"), *columns], ["conv_id", "piece", *names])

    kind = table.schema["conv_id"].dataType.simpleString()
    return table.mapInArrow(light(run), f"conv_id {kind}, piece long, n_turns long, n_lines long, n_right long, n_found long, roles string, rendered_sha256 string")
