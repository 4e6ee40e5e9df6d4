"""Chat formatting: raw transcripts to canonical turns.

A hidden Markov model reads a transcript line by line. Its states are the first or a later line of a system, user or assistant
turn; what it sees of a line is the speaker marker, the line's length class, a question mark at its end and a blank line before
it. A marker of another form than most of the transcript's is seen as a stray one. The Viterbi path gives turns and roles, also
where markers are missing or strange; a marker is taken off only where the path begins a turn with it.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import crc, lookup, written

ROLES = ["system", "user", "assistant"]
#: Speaker markers (fixed values). The order is that of the model's observations; none is the last.
MARKERS = ["system:", "user:", "human:", "q:", "assistant:", "ai:", "a:", "### system", "### user", "### assistant", "<|system|>", "<|user|>", "<|assistant|>", "instructions:", "customer:", "bot:"]
#: Marker of each role by writing style (fixed values).
STYLES = [("System:", "User:", "Assistant:"), ("Instructions:", "Human:", "AI:"), ("### System", "### User", "### Assistant"), ("<|system|>", "<|user|>", "<|assistant|>"), ("System:", "Q:", "A:"), ("Instructions:", "Customer:", "Bot:")]
_MARKER = re.compile(r"\s*(" + "|".join(re.escape(m) for m in sorted(MARKERS, key=len, reverse=True)) + r")\s*", re.IGNORECASE)
_INDEX = {m: i for i, m in enumerate(MARKERS)}
#: Form of a marker: a word, a letter, a heading or a tag; system: goes with words and letters alike.
_FORM = {m: "heading" if m[0] == "#" else "tag" if m[0] == "<" else "letter" if len(m) == 2 else "any" if m == "system:" else "word" for m in MARKERS}
_NONE, _STRAY = len(MARKERS), len(MARKERS) + 1
#: Turns of one transcript; a longer conversation is several transcripts.
PART_TURNS = 512
#: Different rows for one turn of a conversation from which on they are no turn but transcripts of their own.
TURN_ROWS = 64
#: Transcripts that training takes at most.
SAMPLE_TRANSCRIPTS = 600
_STATES = 2 * len(ROLES)
_SHAPES = (len(MARKERS) + 2, 5, 2, 2)


@dataclass
class ChatModel:
    """Log probabilities: of the first state, of a state after another, and of each observed feature by state."""

    start: np.ndarray
    step: np.ndarray
    seen: list[np.ndarray]


def observe(transcript: str) -> tuple[list[tuple[str, str, int]], np.ndarray]:
    """((line, line without its marker, blank lines before) of each line with content; their features)."""
    read, blank = [], 0
    for line in transcript.split("\n"):
        if not line.strip():
            blank += 1
            continue
        found = _MARKER.match(line)
        read.append((line, found[1].lower() if found else None, line[found.end() :] if found else line, blank))
        blank = 0
    forms = Counter(_FORM[m] for _, m, _, _ in read if m and _FORM[m] != "any")
    usual = max(forms, key=forms.get) if forms else "any"  # at ties the first
    lines, features = [], []
    for i, (line, marker, rest, blank) in enumerate(read):
        stray = marker is not None and _FORM[marker] != usual and not (_FORM[marker] == "any" and usual in ("word", "letter", "any"))
        rest = line if stray else rest
        size = min(4, int(np.searchsorted([1, 40, 120, 400], len(rest), side="right")))
        lines.append((line, rest, blank))
        features.append((_NONE if marker is None else _STRAY if stray else _INDEX[marker], size, rest.rstrip().endswith("?"), blank > 0 or i == 0))
    return lines, np.array(features, np.int64).reshape(-1, len(_SHAPES))


def train(examples: list[tuple[np.ndarray, np.ndarray]]) -> ChatModel:
    """Smoothed maximum likelihood from (features, states) of labelled transcripts."""
    start, step, seen = np.full(_STATES, 0.5), np.full((_STATES, _STATES), 0.05), [np.full((_STATES, n), 0.05) for n in _SHAPES]
    for role in range(len(ROLES)):  # a later line never follows another role's turn
        step[:, 2 * role + 1] = 1e-6
        step[2 * role : 2 * role + 2, 2 * role + 1] = 0.5
    start[1::2] = 1e-6
    for features, states in examples:
        if len(states):
            start[states[0]] += 1
            np.add.at(step, (states[:-1], states[1:]), 1)
            for k, counts in enumerate(seen):
                np.add.at(counts, (states, features[:, k]), 1)
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return ChatModel(log(start), log(step), [log(x) for x in seen])


def viterbi(model: ChatModel, features: np.ndarray) -> np.ndarray:
    """Most likely states; at ties the earlier state."""
    n = len(features)
    if not n:
        return np.zeros(0, np.int64)
    scores = sum(model.seen[k][:, features[:, k]] for k in range(features.shape[1])).T
    back, now = np.zeros((n, _STATES), np.int64), model.start + scores[0]
    for t in range(1, n):
        ways = now[:, None] + model.step
        back[t] = ways.argmax(axis=0)
        now = ways[back[t], np.arange(_STATES)] + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = now.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def parse(model: ChatModel, transcript: str | None) -> list[tuple[str, str]]:
    """(role, text) of each turn of a transcript; none for null or blank transcripts. Blank lines inside a turn are kept."""
    lines, features = observe(transcript or "")
    turns: list[tuple[str, list[str]]] = []
    for (line, rest, blank), state in zip(lines, viterbi(model, features).tolist(), strict=True):
        role = ROLES[state // 2]
        if state % 2 == 0 or not turns or turns[-1][0] != role:
            turns.append((role, [rest]))
        else:
            turns[-1][1].extend([""] * blank + [line])
    return [(role, canonical("\n".join(text))) for role, text in turns]


def canonical(text: str | None) -> str:
    """A turn's text without white space at its ends."""
    return (text or "").strip()


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical form: one JSON object a turn and line."""
    return "\n".join(json.dumps({"role": role, "content": text}, ensure_ascii=False) for role, text in turns)


def write_transcript(key: int | None, turns: list[tuple[str | None, str | None]]) -> tuple[str, list[int]]:
    """(raw transcript of known turns, state of each line with content). Style and missing markers follow from the key alone.

    Some turns after the first have no marker, only the blank line before them; turns without text, and those whose text begins
    like a marker, always have one. A third of the transcripts have no blank line before a marker. Unknown roles are written as
    user's.
    """
    style, parts, states = STYLES[crc(f"style/{key}") % len(STYLES)], [], []
    narrow = crc(f"gap/{key}") % 3 == 0
    for i, (role, text) in enumerate(turns):
        r = ROLES.index(role) if role in ROLES else 1
        body = canonical(text)
        marked = i == 0 or not body or bool(_MARKER.match(body)) or crc(f"marker/{key}/{i}") % 9 != 0
        own_line = style[r][-1] != ":"
        parts.append((style[r] + ("\n" if own_line else " ") if marked else "") + body)
        n = len([x for x in parts[-1].split("\n") if x.strip()])
        parts[-1] = ("" if i == 0 else "\n" if narrow and marked else "\n\n") + parts[-1]
        states += [2 * r] + [2 * r + 1] * (n - 1)
    return "".join(parts), states


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, turns): the turns in order, at most PART_TURNS numbers a part. Repeated rows count once.

    A row without conv_id or turn is a transcript of its own, and so is each of more than TURN_ROWS different rows for one turn:
    no group holds more than PART_TURNS * TURN_ROWS rows.
    """
    rows = written(conversations.select("conv_id", "turn", "role", "text").distinct().withColumn("__turn", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), "turns")
    crowded = written(rows.groupBy("__turn").agg(F.count("*").alias("n")).where(F.col("n") > TURN_ROWS).withColumn("crowded", F.lit(True)), "crowded-turns")
    loose = F.col("conv_id").isNull() | F.col("turn").isNull() | F.col("crowded").isNotNull()
    part: Column = F.when(loose, F.xxhash64("conv_id", "turn", "role", "text")).otherwise(F.floor(F.col("turn") / PART_TURNS))
    return lookup(rows, crowded, "__turn", "n").withColumn("part", part).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def train_on(grouped: DataFrame) -> ChatModel:
    """Learns from a bounded sample of transcripts, of conversations whose crc32(conv_id) mod 5 is not 0."""
    key = F.xxhash64("conv_id", "part")
    usable = grouped.where(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 != 0)
    share = max(1, usable.count() // (2 * SAMPLE_TRANSCRIPTS))
    rows = usable.where(F.pmod(key, F.lit(share)) == 0).orderBy(key).limit(SAMPLE_TRANSCRIPTS).collect()
    examples = []
    for row in rows:
        text, states = write_transcript(row["conv_id"], [(t["role"], t["text"]) for t in row["turns"]])
        _, features = observe(text)
        if len(features) == len(states):
            examples.append((features, np.array(states, np.int64)))
    return train(examples)


def parsed_conversations(conversations: DataFrame) -> DataFrame:
    """One row a transcript: conv_id, part, n_turns, roles (comma-joined), rendered, agreement, recovered.

    The turns are written as a raw transcript, of which the model sees only the text; agreement is the share of lines whose
    role it recovers, recovered tells whether all turns came back with role and text. Null texts are empty turns, null roles
    count as user.
    """
    grouped = written(transcripts(conversations), "transcripts")
    given = conversations.sparkSession.sparkContext.broadcast(train_on(grouped))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, turns in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, states = write_transcript(key, [(t["role"], t["text"]) for t in turns])
                found = parse(given.value, text)
                path = viterbi(given.value, observe(text)[1])
                same = float(np.mean(path // 2 == np.array(states) // 2)) if len(path) == len(states) else 0.0
                whole = found == [(t["role"] if t["role"] in ROLES else "user", canonical(t["text"])) for t in turns]
                for column, value in zip(out, (len(found), ",".join(r for r, _ in found), render(found), same, whole), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.bool_())],
                names=["conv_id", "part", "n_turns", "roles", "rendered", "agreement", "recovered"],
            )

    return grouped.mapInArrow(run, "conv_id long, part long, n_turns long, roles string, rendered string, agreement double, recovered boolean")
