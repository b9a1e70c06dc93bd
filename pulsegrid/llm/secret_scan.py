"""Secret scans (operator 9, DataFrame functions only).

Base rules find assignments, access keys and hex strings. The method adds long
tokens that look random: two character Markov models, one of random strings and
one of ordinary identifiers, are learned from labelled samples, and a token is
reported when the log-likelihood ratio of its transitions is high.

Matches are located without Python: each match is put between marker characters
by one ``regexp_replace``, the text is split at the markers, and offsets are
running sums of the segment lengths (code points).
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.store import held_out, read_table

OPEN, MID, CLOSE, PLAIN = "\x01", "\x02", "\x03", "\x04"

# The base rules by kind: prefix group, value group, least length of the value or of the whole match.
ASSIGN_PREFIX = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)"""
ASSIGN_VALUE = r"[A-Za-z0-9+/_.=-]+"
ASSIGN_LEAST = 12
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")  # a text without any of them has no assignment
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: Characters of a token the models judge, and its least length.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z_][A-Za-z0-9_]{5,}"
ALPHABET = 128


def _clean(text: Column) -> Column:
    """Null as empty; the marker characters, which no rule can match, become another such character."""
    text = F.coalesce(text, F.lit(""))
    marked = text.contains(OPEN) | text.contains(MID) | text.contains(CLOSE)
    return F.when(marked, F.translate(text, OPEN + MID + CLOSE, PLAIN * 3)).otherwise(text)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _offsets(lengths: Column) -> Column:
    """Running sums (exclusive) of a non-empty array in blocks, so that a long array costs n^1.5 and not n^2 steps."""
    zero = F.lit(0).cast("int")

    def total(values: Column) -> Column:
        return F.aggregate(values, zero, lambda acc, x: acc + x)

    def from_bases(block: Column, bases: Column) -> Column:
        return F.transform(
            F.sequence(zero, F.size(lengths) - 1),
            lambda i: F.get(bases, F.floor(i / block).cast("int"))
            + total(F.slice(lengths, F.floor(i / block).cast("int") * block + 1, i % block)),
        )

    def by_blocks(block: Column) -> Column:
        blocks = F.sequence(zero, F.floor(F.size(lengths) / block).cast("int"))
        totals = F.transform(blocks, lambda b: total(F.slice(lengths, b * block + 1, block)))
        return _let(totals, lambda sums: _let(F.transform(blocks, lambda b: total(F.slice(sums, F.lit(1), b))), lambda bases: from_bases(block, bases)))

    return _let(F.ceil(F.sqrt(F.size(lengths))).cast("int"), by_blocks)


def _matches(text: Column, prefix: str, value: str, least: int) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches whose value has ``least`` characters."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def located(segments: Column, lengths: Column, offsets: Column) -> Column:
        # Segments go (rest, prefix, value) over and over and end with a rest.
        return F.transform(
            F.sequence(F.lit(0), (F.size(segments) / 3).cast("int") - 1),
            lambda k: F.struct(
                F.get(offsets, k * 3 + 1).alias("start"),
                (F.get(offsets, k * 3 + 2) + F.get(lengths, k * 3 + 2)).alias("end"),
                F.get(segments, k * 3 + 2).alias("value"),
            ),
        )

    def from_segments(segments: Column) -> Column:
        return _let(F.transform(segments, F.length), lambda lengths: _let(_offsets(lengths), lambda offsets: located(segments, lengths, offsets)))

    def from_marked(marked: Column) -> Column:
        found = _let(F.split(marked, f"[{OPEN}{MID}{CLOSE}]"), from_segments)
        return F.when(marked.contains(OPEN), F.filter(found, lambda m: F.length(m["value"]) >= least)).otherwise(empty)

    return _let(F.regexp_replace(text, f"({prefix})({value})", f"{OPEN}$1{MID}$2{CLOSE}"), from_marked)


def base_matches(text: Column) -> dict[str, Column]:
    """Matches of each base rule; ``text`` must come from :func:`_clean`."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    keyed = _let(F.lower(text), lambda low: reduce(or_, [low.contains(word) for word in ASSIGN_WORDS]))
    return {
        "assign": F.when(keyed, _matches(text, ASSIGN_PREFIX, ASSIGN_VALUE, ASSIGN_LEAST)).otherwise(none),
        "access": F.when(text.contains("AKIA"), _matches(text, "", ACCESS, 0)).otherwise(none),
        "hex": _matches(text, "", HEX, 0),
    }


def transition_counts(samples: DataFrame) -> DataFrame:
    """(label, a, b) -> n over the ASCII character pairs of samples(token, label).

    Null tokens and tokens of one character give nothing. At most 2 * 128 * 128 rows come out.
    """
    codes = F.transform(F.split("token", ""), F.ascii)
    pairs = samples.select("label", codes.alias("codes")).where(F.size("codes") > 1)
    pairs = pairs.select(
        "label",
        F.explode(F.arrays_zip(F.expr("slice(codes, 1, size(codes) - 1)").alias("a"), F.expr("slice(codes, 2, size(codes) - 1)").alias("b"))).alias("p"),
    )
    pairs = pairs.select("label", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    pairs = pairs.where(F.col("a").between(0, ALPHABET - 1) & F.col("b").between(0, ALPHABET - 1))
    return pairs.groupBy("label", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def fit_markov(samples: DataFrame, smoothing: float = 0.5) -> Column:
    """Literal array of log(P_random(b | a) / P_ordinary(b | a)) at a * 128 + b from samples(token, label 0/1).

    Only the pair counts reach the driver, at most 2 * 128 * 128 rows.
    Without samples every ratio is 0 and no token is reported.
    """
    counts = {0: {}, 1: {}}
    for label, a, b, n in transition_counts(samples).where(F.col("label").isin(0, 1)).collect():
        counts[label][a, b] = n
    totals = {label: {} for label in counts}
    for label, table in counts.items():
        for (a, _), n in table.items():
            totals[label][a] = totals[label].get(a, 0) + n
    kinds = 66  # characters a token can hold
    # A pair that was not seen falls back on how often its second character occurs at all.
    single = {label: [smoothing] * ALPHABET for label in counts}
    for label, table in counts.items():
        for (_, b), n in table.items():
            single[label][b] += n
    whole = {label: sum(totals[label].values()) + smoothing * kinds for label in counts}

    def log_p(label: int, a: int, b: int) -> float:
        back = kinds * smoothing * single[label][b] / whole[label]
        return math.log((counts[label].get((a, b), 0) + back) / (totals[label].get(a, 0) + smoothing * kinds))

    ratios = (log_p(1, a, b) - log_p(0, a, b) for a in range(ALPHABET) for b in range(ALPHABET))
    return F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")


def log_ratio(token: Column, ratios: Column) -> Column:
    """Log-likelihood ratio of an ASCII token, random over ordinary."""

    def total(codes: Column) -> Column:
        steps = F.zip_with(
            F.slice(codes, F.lit(1), F.size(codes) - 1),
            F.slice(codes, F.lit(2), F.size(codes) - 1),
            lambda a, b: F.get(ratios, a * ALPHABET + b),
        )
        return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))

    return _let(F.transform(F.split(token, ""), F.ascii), total)


def scan(df: DataFrame, text: str, ratios: Column, least_ratio: float = 12.0) -> DataFrame:
    """``df`` with ``found``: array<struct<start, kind, end>> in order of start, then kind as in ``KINDS``.

    Base matches stay as they are. A token is added as ``random`` when its log
    ratio is at least ``least_ratio`` and it touches no base match. Null and
    empty texts give an empty array; a column ``found`` of ``df`` is replaced.
    """
    span = "array<struct<start:int,kind:int,end:int>>"
    df = df.drop("found").withColumn("_text", _clean(F.col(f"`{text}`")))
    base = base_matches(F.col("_text"))
    df = df.withColumns({f"_{kind}": matches for kind, matches in base.items()} | {"_tokens": _matches(F.col("_text"), "", TOKEN, 0)})

    def spans(kind: str, column: str) -> Column:
        return F.transform(F.col(column), lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"))).cast(span)

    df = df.withColumn("_base", F.concat(*[spans(k, f"_{k}") for k in KINDS[:3]]))
    random = F.filter(
        F.col("_tokens"),
        lambda t: ~F.exists(F.col("_base"), lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
        & (log_ratio(t["value"], ratios) >= least_ratio),
    )
    df = df.withColumn("_tokens", random)
    found = F.array_sort(F.concat(F.col("_base"), spans("random", "_tokens")))
    return df.withColumn("found", found).drop("_text", "_base", "_tokens", "_assign", "_access", "_hex")


def as_text(found: Column, kinds: int = len(KINDS)) -> Column:
    """``kind:start:end`` of the first ``kinds`` kinds, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter(found, lambda s: s["kind"] < kinds)
    parts = F.transform(kept, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def labelled_tokens(docs: DataFrame, rows: int) -> DataFrame:
    """samples(token, label) from about ``rows`` documents outside the held-out fold, chosen by the hash of the id.

    Values of base matches are random strings (1), words that occur outside
    them are ordinary identifiers (0).
    """
    train = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull()).select("doc_id", "text")
    total = train.count()
    share = min(1.0, rows / max(total, 1))
    draw = F.crc32(F.concat(F.lit("markov:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    train = train.where(draw < share * 2**32).select(_clean(F.col("text")).alias("text"))
    matches = F.concat(*base_matches(F.col("text")).values())
    secrets = train.select(F.explode(F.transform(matches, lambda m: m["value"])).alias("token"), F.lit(1).alias("label"))
    rest = F.regexp_replace(F.regexp_replace(F.col("text"), f"{ASSIGN_PREFIX}{ASSIGN_VALUE}", " "), f"{ACCESS}|{HEX}", " ")
    words = train.select(F.explode(F.regexp_extract_all(rest, F.lit(f"({WORD})"), 1)).alias("token"), F.lit(0).alias("label"))
    return secrets.unionByName(words)


#: Documents the Markov models learn from, at most about this many (a bound of the fit, not of the scan).
TRAIN_ROWS = 4000


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of documents: base counts, digest of the base spans, all spans."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = fit_markov(labelled_tokens(docs, TRAIN_ROWS))
    found = scan(docs, "text", ratios)

    def count(kind: str) -> Column:
        return F.size(F.filter(F.col("found"), lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(as_text(F.col("found"), 3).cast("binary"), 256).alias("base_sha256"),
        as_text(F.col("found")).alias("spans"),
    )


def redact(df: DataFrame, text: str, found: str, mask: str = "<secret>") -> DataFrame:
    """``df`` with each union of overlapping spans in ``found`` replaced by ``mask`` in ``text``.

    Texts without spans stay as they are, null included.
    """
    spans, body = F.col(found), F.col(f"`{text}`")
    # A span opens a union when it starts at or after the ends of all spans before it.
    merged = F.aggregate(
        spans,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(
                    F.try_element_at(acc, F.lit(-1))["start"].alias("start"),
                    F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"),
                )),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    df = df.withColumn("_merged", merged)
    merged = F.col("_merged")
    kept = F.transform(
        F.sequence(F.lit(0), F.size(merged)),
        lambda i: F.substring(
            body,
            F.coalesce(F.get(merged, i - 1)["end"], F.lit(0)) + 1,
            F.coalesce(F.get(merged, i)["start"], F.length(body)) - F.coalesce(F.get(merged, i - 1)["end"], F.lit(0)),
        ),
    )
    return df.withColumn(text, F.when(F.size(spans) > 0, F.array_join(kept, mask)).otherwise(body)).drop("_merged")
