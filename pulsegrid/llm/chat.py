"""Chat formatting (operator 10): roles of transcript lines by a hidden Markov model, then canonical turns.

The states are (role, first or later line of a turn). Each line shows a speaker
marker, a length class and a closing character. Counts of labelled lines give the
model; Viterbi recovers the states of a transcript, so that turns whose marker is
missing are found from what the lines look like and what usually follows what.

A transcript of any length is cut into chunks of ``CHUNK_LINES`` lines. Each long
transcript first gives one states x states matrix per chunk (best scores
between its ends); a pass over these matrices fixes the states at the cuts; then
all chunks are decoded on their own. The result is that of one Viterbi pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pulsegrid.llm.store import held_out, read_table, stored

CHUNK_LINES = 512
BLOCK_TURNS = 64
#: Conversations the model learns from, about; a bound of the fit only.
TRAIN_ROWS = 5000
MAX_ROLES = 16

# Names that mark a speaker at the head of a line, by class 1 (asks), 2 (answers), 3 (sets the frame); 4 is any other name.
SPEAKERS = (("user", "human", "question", "q", "customer"), ("assistant", "ai", "bot", "answer", "a", "agent"), ("system", "instruction", "context"))
MARKER = r"^[\s#*>\[<|-]{0,6}([A-Za-z]{1,12})[\]>|*]{0,4}\s?:[\s*]{0,4}"
N_MARKER, N_LENGTH, N_END = 5, 12, 4


def observe(line: Column) -> Column:
    """Observation number of a line: marker class, length class and closing character."""
    name = F.lower(F.regexp_extract(line, MARKER, 1))
    marker = F.when(name == "", 0)
    for kind, names in enumerate(SPEAKERS, 1):
        marker = marker.when(name.isin(*names), kind)
    marker = marker.otherwise(4)
    length = F.least(F.floor(F.log2(F.length(line) + 1.0)), F.lit(N_LENGTH - 1)).cast("int")
    last = F.right(F.rtrim(line), F.lit(1))
    end = F.when(last == "?", 1).when(last.isin(".", "!"), 2).when(last.isin(":", ","), 3).otherwise(0)
    return ((marker * N_LENGTH + length) * N_END + end).cast("int")


def without_speaker(line: Column, roles: list[str]) -> Column:
    """``line`` without the marker at its head, if the name there is one of ``SPEAKERS`` or a role; else all of it."""
    names = {name for kind in SPEAKERS for name in kind} | {role.lower() for role in roles}
    return F.when(F.lower(F.regexp_extract(line, MARKER, 1)).isin(*sorted(names)), F.regexp_replace(line, MARKER, "")).otherwise(line)


def to_lines(turns: DataFrame) -> DataFrame:
    """(conv, pos, line, role, first) of turns(conv, turn, role, text): lines with dense positions per transcript.

    Equal turn numbers are put in the order of the text's hash; a null text is one
    empty line. Positions are sums over blocks of turns and places in the block, so
    no task orders a whole transcript.
    """
    rows = turns.select("conv", "turn", "role", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    rows = rows.withColumns({"n": F.size("lines"), "tie": F.xxhash64("lines"), "block": F.floor(F.col("turn") / BLOCK_TURNS)})
    sizes = rows.groupBy("conv", "block").agg(F.sum("n").alias("m"))
    before = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("conv", "block").orderBy("turn", "tie").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    same = rows["conv"].eqNullSafe(sizes["c"]) & rows["block"].eqNullSafe(sizes["b"])
    rows = rows.join(sizes, same).select("conv", "role", (F.col("base") + F.col("at")).alias("start"), F.posexplode("lines").alias("i", "line"))
    return rows.select("conv", (F.col("start") + F.col("i")).cast("long").alias("pos"), "line", "role", (F.col("i") == 0).alias("first"))


def fit(lines: DataFrame) -> dict:
    """The model from labelled lines(conv, pos, line, role, first): roles and log-probabilities as plain lists.

    Only counts of states and features reach the driver. Lines without a role are left
    out. Without any line the only role is ``user``.
    """
    lines = lines.where(F.col("role").isNotNull()).withColumn("obs", observe(F.col("line")))
    roles = sorted(r["role"] for r in lines.select("role").distinct().limit(MAX_ROLES + 1).collect())
    if len(roles) > MAX_ROLES:
        raise ValueError(f"more than {MAX_ROLES} roles")
    roles = roles or ["user"]
    n = 2 * len(roles)
    number = F.lit(0)
    for i, role in enumerate(roles):
        number = F.when(F.col("role") == role, i).otherwise(number)
    state = lines.select("conv", "pos", "obs", (2 * number + (~F.col("first")).cast("int")).alias("state"))
    previous = F.lag("state").over(W.partitionBy("conv").orderBy("pos"))
    steps = state.withColumn("before", previous).groupBy("before", "state").count().collect()
    seen = state.groupBy("state", "obs").count().collect()
    start, step = np.full(n, 0.1), np.full((n, n), 0.01)
    features = [np.full((n, size), 0.5) for size in (N_MARKER, N_LENGTH, N_END)]
    for before, to, count in steps:
        if before is None:
            start[to] += count
        else:
            step[before, to] += count
    for of, obs, count in seen:
        rest, end = divmod(obs, N_END)
        for table, value in zip(features, (*divmod(rest, N_LENGTH), end)):
            table[of, value] += count
    for r in range(len(roles)):  # a first line never follows from nothing as a later line
        start[2 * r + 1] = 1e-9
        for s in range(n):
            if s // 2 != r:
                step[s, 2 * r + 1] = 1e-9
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    marker, length, end = (log(f) for f in features)
    emission = (marker[:, :, None, None] + length[:, None, :, None] + end[:, None, None, :]).reshape(n, -1)
    return {"roles": roles, "start": log(start), "step": log(step), "emission": emission.T.copy()}


class Viterbi:
    def __init__(self, model: dict) -> None:
        self.start, self.step, self.emission = model["start"], model["step"], model["emission"]

    def transfer(self, obs: np.ndarray) -> np.ndarray:
        """[i, j]: best score from state i before the lines to state j at the last of them."""
        best = self.step + self.emission[obs[0]]
        for o in obs[1:].tolist():
            best = (best[:, :, None] + self.step).max(axis=1) + self.emission[o]
        return best

    def path(self, obs: np.ndarray, before: int | None = None, last: int | None = None) -> np.ndarray:
        """Best states, given the state before the lines and that of the last line if they are known. Ties go to the lower state."""
        score = (self.start if before is None else self.step[before]) + self.emission[obs[0]]
        back = np.zeros((len(obs), len(self.start)), np.int64)
        for t, o in enumerate(obs[1:].tolist(), 1):
            ways = score[:, None] + self.step
            back[t] = ways.argmax(axis=0)
            score = ways.max(axis=0) + self.emission[o]
        states = np.zeros(len(obs), np.int64)
        states[-1] = int(score.argmax()) if last is None else last
        for t in range(len(obs) - 1, 0, -1):
            states[t - 1] = back[t, states[t]]
        return states

    def cuts(self, first: np.ndarray, matrices: list[np.ndarray]) -> list[int]:
        """State at the end of each chunk, from the scores at the end of the first and the matrices of the others."""
        score, back = first, []
        for matrix in matrices:
            ways = score[:, None] + matrix
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0)
        ends = [int(score.argmax())]
        for choice in reversed(back):
            ends.append(int(choice[ends[-1]]))
        return ends[::-1]


def recover(lines: DataFrame, model: dict) -> DataFrame:
    """Recovered turns (conv, turn, role, text, n_lines, n_right) of lines(conv, pos, line[, role]).

    ``role`` is only compared with what was recovered (``n_right``, 0 where null). The
    marker at the head of a turn is taken off if it names a speaker. Turn numbers are gapless from 0.
    """
    spark = lines.sparkSession
    conv = lines.schema["conv"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)
    part = F.struct("pos", observe(F.col("line")).alias("obs"), "line", without_speaker(F.col("line"), model["roles"]).alias("bare"), "role")
    chunks = lines.select("conv", F.floor(F.col("pos") / CHUNK_LINES).alias("chunk"), part.alias("part"))
    chunks = chunks.groupBy("conv", "chunk").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    chunks = stored(chunks, "chunks")
    long = chunks.where(F.col("chunk") > 0).select(F.col("conv").alias("c")).distinct()
    long = chunks.join(long, chunks["conv"].eqNullSafe(long["c"]), "left_semi").select("conv", "chunk", F.col("parts.obs").alias("obs"))

    def matrices(batches):
        viterbi = Viterbi(shared.value)
        for batch in batches:
            chunk = batch.column("chunk")
            out = []
            for c, obs in zip(chunk.to_pylist(), batch.column("obs").to_pylist()):
                obs = np.array(obs)
                if c:
                    out.append(viterbi.transfer(obs).ravel())
                else:
                    score = viterbi.start + viterbi.emission[obs[0]]
                    for o in obs[1:].tolist():
                        score = (score[:, None] + viterbi.step).max(axis=0) + viterbi.emission[o]
                    out.append(score)
            yield pa.RecordBatch.from_arrays([batch.column("conv"), chunk, pa.array(out, pa.list_(pa.float64()))], names=["conv", "chunk", "matrix"])

    summed = long.mapInArrow(matrices, f"conv {conv}, chunk long, matrix array<double>")
    summed = summed.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("chunk", "matrix"))).alias("m"))

    def ends(batches):
        viterbi = Viterbi(shared.value)
        n = len(viterbi.start)
        for batch in batches:
            states = []
            for m in batch.column("m").to_pylist():
                states.append(viterbi.cuts(np.array(m[0]["matrix"]), [np.array(x["matrix"]).reshape(n, n) for x in m[1:]]))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(states, pa.list_(pa.int32()))], names=["conv", "ends"])

    known = summed.mapInArrow(ends, f"conv {conv}, ends array<int>").select(F.col("conv").alias("c"), F.posexplode("ends").alias("k", "last"), "ends")
    known = known.select("c", "k", "last", F.get("ends", F.col("k") - 1).alias("before"))
    placed = chunks.join(known, chunks["conv"].eqNullSafe(known["c"]) & (chunks["chunk"] == known["k"]), "left").select("conv", "chunk", "parts", "before", "last")

    def decode(batches):
        model = shared.value
        viterbi, roles = Viterbi(model), model["roles"]
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            columns = [batch.column(c).to_pylist() for c in ("conv", "chunk", "parts", "before", "last")]
            for conv_, chunk, parts, before, last in zip(*columns):
                states = viterbi.path(np.array([p["obs"] for p in parts]), before, last)
                heads = states % 2 == 0
                speaker = states // 2
                heads[1:] |= speaker[1:] != speaker[:-1]
                heads[0] |= before is None or before // 2 != speaker[0]
                cuts = np.unique(np.concatenate([[0], np.flatnonzero(heads)])).tolist()
                for a, b in zip(cuts, [*cuts[1:], len(parts)]):
                    role = roles[speaker[a]]
                    body = [parts[i]["bare"] if i == a and heads[a] else parts[i]["line"] for i in range(a, b)]
                    right = sum(parts[i]["role"] == role for i in range(a, b))
                    for column, value in zip(out, (conv_, chunk, bool(heads[a]), role, "\n".join(body), b - a, right)):
                        column.append(value)
            kinds = [batch.column("conv").type, pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["conv", "chunk", "head", "role", "text", "n_lines", "n_right"])

    # Segments come in order within a chunk; their number there is counted before any shuffle.
    def numbered(batches):
        for batch in decode(batches):
            conv_, chunk = batch.column("conv").to_pylist(), batch.column("chunk").to_pylist()
            place, heads, last, at, count = [], [], None, 0, 0
            for key, head in zip(zip(conv_, chunk), batch.column("head").to_pylist()):
                at, count = (at + 1, count + head) if key == last else (0, int(head))
                last = key
                place.append(at)
                heads.append(count)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place, pa.int64()), pa.array(heads, pa.int64())], names=[*batch.schema.names, "place", "heads"]
            )

    schema = f"conv {conv}, chunk long, head boolean, role string, text string, n_lines long, n_right long, place long, heads long"
    segments = stored(placed.mapInArrow(numbered, schema), "segments")
    begun = segments.groupBy("conv", "chunk").agg(F.max("heads").alias("h"))
    before = W.partitionBy("conv").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    begun = begun.select(F.col("conv").alias("c"), F.col("chunk").alias("k"), F.coalesce(F.sum("h").over(before), F.lit(0)).alias("base"))
    turns = segments.join(begun, segments["conv"].eqNullSafe(begun["c"]) & (segments["chunk"] == begun["k"]))
    turns = turns.withColumn("turn", F.col("base") + F.col("heads") - 1)
    turns = turns.groupBy("conv", "turn").agg(
        F.min_by("role", F.struct("chunk", "place")).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "place", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.sum("n_lines").alias("n_lines"), F.sum("n_right").alias("n_right"),
    )
    return turns


def render(role: Column, text: Column) -> Column:
    """Canonical form of a turn."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.trim(text), F.lit("<|end|>\n"))


def transcribe(turns: DataFrame) -> DataFrame:
    """``turns`` as people write them down: speaker names in one of four styles per transcript, missing on a quarter of the turns."""
    style = F.pmod(F.crc32(F.coalesce(F.col("conv").cast("string"), F.lit("")).cast("binary")), F.lit(4))
    named = F.pmod(F.crc32(F.concat_ws(":", F.col("conv").cast("string"), F.col("turn").cast("string"), F.lit("name")).cast("binary")), F.lit(4)) > 0
    names = {"user": ("User: ", "### Human: ", "Q: ", "**Customer**: "), "assistant": ("Assistant: ", "### AI: ", "A: ", "**Agent**: "), "system": ("System: ", "### Instruction: ", "Context: ", "**System**: ")}
    marker = F.concat(F.initcap(F.coalesce(F.col("role"), F.lit("user"))), F.lit(": "))
    for role, styles in names.items():
        for i, text in enumerate(styles):
            marker = F.when((F.col("role") == role) & (style == i), text).otherwise(marker)
    return turns.withColumn("text", F.concat(F.when(named, marker).otherwise(""), F.coalesce("text", F.lit(""))))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of all conversations back to turns: (conv_id, turn, role, n_lines, n_right, held_out, rendered).

    A transcript is the conversation's turns with informal speaker names, some missing.
    The model learns from conversations outside the held-out fold.
    """
    table = read_table(spark, sf_dir, "conversations")
    turns = transcribe(table.select(F.col("conv_id").alias("conv"), "turn", "role", "text"))
    train = turns.where(~held_out(F.col("conv")))
    draw = F.crc32(F.concat(F.lit("chat:"), F.coalesce(F.col("conv").cast("string"), F.lit(""))).cast("binary"))
    total = train.select("conv").distinct().count()
    model = fit(to_lines(train.where(draw < min(1.0, TRAIN_ROWS / max(1, total)) * 2.0**32)))
    found = recover(to_lines(turns), model)
    return found.select(
        F.col("conv").alias("conv_id"), "turn", "role", "n_lines", "n_right", held_out(F.col("conv")).alias("held_out"),
        render(F.col("role"), F.col("text")).alias("rendered"),
    )
