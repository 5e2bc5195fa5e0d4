"""Chat formatting: roles of raw transcripts by a hidden Markov model, then canonical turns.

A transcript is a text whose turns may or may not begin with speaker markers (``User:``, ``### Assistant``,
``Q.``, ``<|system|>`` ...). Every line is an observation: its marker, whether a blank line stands before it, its
length, whether it asks. States are (role, first line of a turn or a later one); Viterbi finds the most probable
sequence, which recovers the roles of unmarked turns and keeps words such as ``Note:`` from starting one. Turns
are then rendered alike.

The tables of the model are counts of laid-out conversations that are not held out, on top of prior counts. A
long conversation is several transcripts, but one sequence to the model: each transcript gives the best score
from every state before it to every state at its end, the conversation's path over these is found first, and each
transcript is then decoded between its two ends, so where a conversation is cut changes no role.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import schema_with
from .langid import held_out

ROLES = ("system", "user", "assistant")
#: Turns that are laid into one transcript; a longer conversation is several transcripts, decoded as one.
SEGMENT_TURNS = 256
STYLES = 5

# Words that name a speaker, by role.
SPEAKERS = {
    "system": "system", "instruction": "system", "instructions": "system", "sys": "system", "context": "system",
    "user": "user", "human": "user", "q": "user", "question": "user", "you": "user", "customer": "user", "me": "user", "prompter": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "a": "assistant", "answer": "assistant", "agent": "assistant", "gpt": "assistant", "model": "assistant", "response": "assistant",
}
_MARKER = re.compile(r"^\s*(?:(?P<tag><\|\s*(?P<t>[A-Za-z]+)\s*\|>|\[(?P<b>[A-Za-z]+)\])|(?P<hash>#{1,6}\s+(?P<h>[A-Za-z]+)\s*:?\s*$)|\**(?P<w>[A-Za-z]+)\**\s*(?P<sep>[:.>])(?=\s|$))\s*")

# States: 2 * role + 0 for the first line of a turn, + 1 for a later one.
_STATES = 2 * len(ROLES)
# What is seen of a line. Marker: 0 none, else 1 + 2 * role + (1 if it is no mere letter with a full stop).
_MARKERS, _LENGTHS = 1 + 2 * len(ROLES), 6
#: Lines that the prior counts of each state amount to.
PRIOR_LINES = 20


def line_of(line: str, blank_before: bool) -> tuple[tuple[int, int, int], int]:
    """(marker and blank line, length class, question) of a line, and where its text begins (behind a marker)."""
    found = _MARKER.match(line)
    name = (found["t"] or found["b"] or found["h"] or found["w"] or "").lower() if found else ""
    role, begin, marker = SPEAKERS.get(name), 0, 0
    if role is not None:
        # a bare letter with a full stop may be a word of the text as well
        strong = bool(found["tag"] or found["hash"]) or found["sep"] == ":"
        marker, begin = 1 + 2 * ROLES.index(role) + strong, found.end()
    size = len(line) - begin
    return (2 * marker + blank_before, min(_LENGTHS - 1, max(0, size.bit_length() - 4)), int(line.rstrip().endswith("?"))), begin


def observed(text: str | None) -> tuple[list[str], list[int], list[tuple], list[int]]:
    """The lines of a transcript, those with a visible character, what is seen of these, and where their texts begin."""
    lines = (text or "").split("\n")
    keep = [i for i, x in enumerate(lines) if x.strip()]
    seen = [line_of(lines[i], i > 0 and not lines[i - 1].strip()) for i in keep]
    return lines, keep, [s for s, _ in seen], [b for _, b in seen]


@dataclass
class Model:
    """Log probabilities: of the first state, of the next state, and of what is seen in each state."""

    start: np.ndarray
    move: np.ndarray
    marker: np.ndarray
    length: np.ndarray
    asks: np.ndarray

    def scores(self, seen: list[tuple]) -> np.ndarray:
        """(lines, states) log likelihoods."""
        m, n, q = np.array(seen, np.int64).reshape(-1, 3).T
        return (self.marker[:, m] + self.length[:, n] + self.asks[:, q]).T


def _prior() -> dict[str, np.ndarray]:
    """Probabilities before any count: turns open with a marker of their role or none, users and assistants alternate."""
    # a system turn opens, users and assistants alternate, few turns repeat a speaker
    turn = np.array([[0.02, 0.88, 0.10], [0.01, 0.04, 0.95], [0.02, 0.92, 0.06]])
    stay = 0.7
    move, marker = np.zeros((_STATES, _STATES)), np.full((_STATES, _MARKERS, 2), 0.002)
    for r in range(len(ROLES)):
        for s in (2 * r, 2 * r + 1):
            move[s, 2 * r + 1] = stay
            move[s, 0::2] = (1 - stay) * turn[r]
        marker[2 * r, 1 + 2 * r :][:2] = [[0.1], [0.4]]
        marker[2 * r, 0] = [0.02, 0.04]
        marker[2 * r + 1] = 1e-6
        marker[2 * r + 1, 1::2] = 0.003
        marker[2 * r + 1, 0] = [0.85, 0.1]
    start = np.array([0.3, 1e-4, 0.6, 1e-4, 0.1, 1e-4])
    whole = lambda x: x / x.sum(-1, keepdims=True)
    return {"start": whole(start), "move": whole(move), "marker": whole(marker.reshape(_STATES, -1)), "length": np.full((_STATES, _LENGTHS), 1 / _LENGTHS), "asks": np.tile([0.8, 0.2], (_STATES, 1))}


def model_of(counts: dict[str, np.ndarray] | None = None) -> Model:
    """The model of counts (those of fit()) on top of the prior."""
    with np.errstate(divide="ignore"):
        table = {k: PRIOR_LINES * p + (counts[k] if counts else 0) for k, p in _prior().items()}
        return Model(**{k: np.log(x / x.sum(-1, keepdims=True)) for k, x in table.items()})


def _tally(batches):
    """Rows (name, cell, n): how often a state began, followed another and showed something, over transcripts with their truth."""
    for batch in batches:
        total = {k: np.zeros(p.shape, np.int64) for k, p in _prior().items()}
        for text, roles, sizes in zip(batch.column("transcript").to_pylist(), batch.column("truth").to_pylist(), batch.column("sizes").to_pylist()):
            _, keep, seen, _ = observed(text)
            first = np.cumsum([0, *sizes])
            turn = np.searchsorted(first, keep, "right") - 1
            before = begun = -1
            for t, (m, n, q) in zip(turn.tolist(), seen):
                # a role of another name ends what is known of the sequence
                state = 2 * ROLES.index(roles[t]) + (t == begun) if roles[t] in ROLES else -1
                if state >= 0:
                    if before >= 0:
                        total["move"][before, state] += 1
                    elif begun < 0:
                        total["start"][state] += 1
                    total["marker"][state, m] += 1
                    total["length"][state, n] += 1
                    total["asks"][state, q] += 1
                before, begun = state, t
        cells = [(k, i, int(n)) for k, x in total.items() for i, n in enumerate(x.ravel()) if n]
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["name", "cell", "n"])


def fit(laid: DataFrame) -> Model:
    """The model of transcripts() whose conversations are not held out. One row of each cell reaches the driver. Eager."""
    B.bounded_batches(laid.sparkSession)
    rows = laid.where(~held_out("conv_id")).select("transcript", "truth", "sizes").mapInArrow(_tally, "name string, cell bigint, n bigint").groupBy("name", "cell").agg(F.sum("n").alias("n")).collect()
    counts = {k: np.zeros(p.size) for k, p in _prior().items()}
    for r in rows:
        counts[r["name"]][r["cell"]] = r["n"]
    return model_of({k: counts[k].reshape(p.shape) for k, p in _prior().items()})


def best_states(scores: np.ndarray, model: Model, before: int | None = None, last: int | None = None) -> list[int]:
    """Viterbi over lines; ties go to the smaller state. before: the state before the first line; last: that of the last one."""
    value = (model.start if before is None else model.move[before]) + scores[0]
    back = np.zeros(scores.shape, np.int8)
    for t in range(1, len(scores)):
        step = value[:, None] + model.move
        back[t] = step.argmax(0)
        value = step.max(0) + scores[t]
    state = int(value.argmax()) if last is None else last
    out = [state]
    for t in range(len(scores) - 1, 0, -1):
        state = int(back[t, state])
        out.append(state)
    return out[::-1]


def best_scores(scores: np.ndarray, model: Model, opens: bool) -> np.ndarray:
    """(before, last): the best log probability of lines between two states; all rows alike if the lines open a conversation."""
    value = (np.tile(model.start, (_STATES, 1)) if opens else model.move) + scores[0]
    for row in scores[1:]:
        value = (value[:, :, None] + model.move[None]).max(1) + row
    return value


def parse(text: str | None, model: Model | None = None, before: int | None = None, last: int | None = None) -> list[tuple[str, str]]:
    """(role, text) of each turn of a transcript; none if it has no line with a visible character.

    Text before the first marker is a turn of its own if the model finds one there. Blank lines inside a turn
    stay, at its ends they go. Without a model the prior is the model.
    """
    model = model or model_of()
    lines, keep, seen, begins = observed(text)
    if not keep:
        return []
    turns: list[tuple[str, list[str]]] = []
    at = -1
    for i, state, begin in zip(keep, best_states(model.scores(seen), model, before, last), begins):
        if state % 2 == 0 or not turns:
            turns.append((ROLES[state // 2], [lines[i][begin:]]))
        else:
            turns[-1][1].extend([""] * (i - at - 1))
            turns[-1][1].append(lines[i])
        at = i
    return [(role, "\n".join(body).strip()) for role, body in turns]


def render(turns: list[tuple[str, str]]) -> str:
    """Turns in canonical form: a role line, the text, an end mark."""
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in turns)


def _format(model: Model):
    def run(batches):
        for batch in batches:
            rest = [c for c in batch.schema.names if c != "__transcript"]
            ends = zip(batch.column("__before").to_pylist(), batch.column("__last").to_pylist()) if "__before" in rest else [(None, None)] * batch.num_rows
            rest = [c for c in rest if c not in ("__before", "__last")]
            turns = [parse(x, model, a, b) for x, (a, b) in zip(batch.column("__transcript").to_pylist(), ends)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array([[r for r, _ in t] for t in turns], pa.list_(pa.string())), pa.array([[x for _, x in t] for t in turns], pa.list_(pa.string())), pa.array([render(t) for t in turns], pa.string())],
                [*rest, "roles", "texts", "rendered"],
            )

    return run


def format_chat(transcripts: DataFrame, text: str = "transcript", model: Model | None = None) -> DataFrame:
    """All other columns of transcripts, and roles, texts and rendered of each row.

    A null or blank transcript has no turns and renders as the empty string. Rows with columns conv_id and
    segment are parts of one conversation, in the order of segment; a blank part has no line and ends nothing.
    """
    B.bounded_batches(transcripts.sparkSession)
    model = model or model_of()
    rest = [c for c in transcripts.columns if c not in (text, "roles", "texts", "rendered")]
    schema = schema_with(transcripts, rest, "roles array<string>, texts array<string>, rendered string")
    rows = transcripts.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text}`").alias("__transcript"))
    if "conv_id" in rest and "segment" in rest:
        ends = _ends(rows, model)
        same = rows["conv_id"].eqNullSafe(ends["__conv"]) & (rows["segment"] == ends["__segment"])
        rows = rows.join(ends, same, "left").drop("__conv", "__segment")
    return rows.mapInArrow(_format(model), schema)


def _ends(rows: DataFrame, model: Model) -> DataFrame:
    """(__conv, __segment, __before, __last): the states at the ends of the parts of conversations of several parts.

    A part of SEGMENT_TURNS turns is one row of 36 scores, and the task of a conversation holds these rows only.
    """
    several = rows.where("segment > 0").select(F.col("conv_id").alias("__conv")).distinct()
    parts = rows.join(several, rows["conv_id"].eqNullSafe(several["__conv"]), "left_semi").select("conv_id", "segment", "__transcript")

    def between(batches):
        for batch in batches:
            scores = []
            for x, s in zip(batch.column("__transcript").to_pylist(), batch.column("segment").to_pylist()):
                seen = observed(x)[2]
                scores.append(best_scores(model.scores(seen), model, s == 0).ravel().tolist() if seen else [])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("segment"), pa.array(scores, pa.list_(pa.float64()))], ["__conv", "__segment", "scores"])

    def chain(key, group):
        group = group.sort_by("__segment")
        segment, tables = group.column("__segment").to_pylist(), [np.array(x).reshape(_STATES, _STATES) if x else None for x in group.column("scores").to_pylist()]
        value, path = None, []
        for table in tables:
            if table is None:
                path.append(None)
                continue
            step = table[:1] if value is None else value[:, None] + table
            path.append(None if value is None else step.argmax(0))
            value = step.max(0)
        out, state = [], None
        for s, table, back in reversed(list(zip(segment, tables, path))):
            if table is None:
                out.append((s, None, None))
                continue
            state = int(value.argmax()) if state is None else state
            before = None if back is None else int(back[state])
            out.append((s, before, state))
            state = before
        out.reverse()
        named = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
        return pa.table([group.column("__conv"), *named], names=["__conv", "__segment", "__before", "__last"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    tables = parts.mapInArrow(between, f"__conv {kind}, __segment bigint, scores array<double>")
    return tables.groupBy("__conv").applyInArrow(chain, f"__conv {kind}, __segment bigint, __before int, __last int")


def style_of(conv_id: str = "conv_id"):
    """The marker style of a conversation, 0 to 4."""
    return F.pmod(F.xxhash64(conv_id), F.lit(STYLES))


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, segment, transcript, truth, sizes): raw transcripts in one of five marker styles, picked by conv_id.

    conversations needs conv_id, turn, role and text; a null text is empty. Turns follow by turn, then role and
    text; equal rows are one turn, and a role of another name, or null, has no marker. In styles 0 to 2 every turn
    is marked. From the third turn on, style 3 marks only what users say and style 4 nothing; a blank line stands
    before an unmarked turn. truth: the roles, sizes: the lines of each turn; both are for fitting and tests.
    """
    name = lambda *pairs: F.create_map(*(F.lit(x) for pair in pairs for x in pair))[F.col("role")]
    style = style_of()
    mark = (
        F.when(style == 0, F.concat(name(("system", "System"), ("user", "User"), ("assistant", "Assistant")), F.lit(": ")))
        .when(style == 1, F.concat(F.lit("### "), name(("system", "Instruction"), ("user", "Human"), ("assistant", "Response")), F.lit(":\n")))
        .when(style == 2, F.concat(F.lit("<|"), F.when(F.col("role").isin(*ROLES), F.col("role")), F.lit("|>\n")))
        .when(style == 3, name(("system", "Context: "), ("user", "Q: "), ("assistant", "A: ")))
        .otherwise(F.concat(name(("system", "[system]"), ("user", "**Human**:"), ("assistant", "**AI**:")), F.lit(" ")))
    )
    turns = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    row = F.struct("turn", "role", "text", F.coalesce(mark, F.lit("\n")).alias("mark"))
    segment = F.coalesce(F.greatest(F.expr(f"turn div {SEGMENT_TURNS}"), F.lit(0)), F.lit(0))
    grouped = turns.groupBy("conv_id", segment.cast("bigint").alias("segment")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    marked = lambda x, i: (style < 3) | ((F.col("segment") == 0) & (i < 2)) | ((style == 3) & x["role"].eqNullSafe("user"))
    parts = F.transform("turns", lambda x, i: F.concat(F.when(marked(x, i), x["mark"]).otherwise("\n"), x["text"]))
    return grouped.select("conv_id", "segment", parts.alias("parts"), F.transform("turns", lambda x: x["role"]).alias("truth")).select(
        "conv_id", "segment", F.array_join("parts", "\n").alias("transcript"), "truth", F.transform("parts", lambda p: F.size(F.split(p, "\n", -1))).alias("sizes")
    )


def chat_report(conversations: DataFrame) -> DataFrame:
    """(conv_id, segment, n_turns, roles, rendered, held_out) of each transcript of the table, by a model fitted to those not held out."""
    laid = transcripts(conversations)
    made = format_chat(laid.drop("truth", "sizes"), model=fit(laid))
    return made.select("conv_id", "segment", F.size("roles").cast("bigint").alias("n_turns"), F.concat_ws(",", "roles").alias("roles"), "rendered", held_out("conv_id").alias("held_out"))
