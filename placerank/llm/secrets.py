"""Secret scan with DataFrame functions only.

Three fixed patterns give the base spans (assignments of credentials, access keys, long hex runs).
The method adds spans: every other token of ``LEAST`` or more identifier characters is scored by
two first-order character Markov models, one of random strings, one of ordinary identifiers, and
becomes a span when the log-likelihood ratio is in favour of a random string. The models are
trained from labelled samples: values that a base pattern found are random, tokens of the same
length range outside base spans are ordinary. A fifth of the samples (by a hash of the token, so that
repeats stay on one side) is held out; the threshold of the mean ratio a transition is the one that
separates the held-out samples best. Counts cover all documents; the model is a table of
``len(ALPHABET)``² numbers at any size of input.

Spans are in code points, end exclusive, leftmost non-overlapping for each pattern.

Defined cases: a null text counts as empty and has no spans; rows are scanned one by one, so ids
may be null or repeated; without base hits the random model is uniform; where a class has no
held-out sample the threshold is ``PRIOR``; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, whole_text

# Fixed patterns of the base kinds, in listed order
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"     # the runs of AKIA[A-Z0-9]+ with 16 characters or more
HEX = r"[0-9a-f]{32,}"            # the runs of [0-9a-f]+ with 32 characters or more
KINDS = ("assign", "access", "hex", "markov")
LEAST_ASSIGN = 8

LEAST = 16
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
SMOOTHING = 0.5
HELD_OUT = 5              # one sample in so many chooses the threshold
STEP, WIDEST = 0.05, 10.0  # scores are counted in steps, up to the widest to both sides
PRIOR = 1.0               # threshold of the mean log-likelihood ratio where none can be learned
BLOCK = 128


def prefix_sums(lengths: Column) -> Column:
    """Exclusive prefix sums of an array of ints, by blocks, so that long arrays stay cheap."""
    def run(xs):  # exclusive sums of a short array, with the total behind
        return F.aggregate(xs, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    n_blocks = F.ceil(F.size(lengths) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(n_blocks - 1, F.lit(0))),
                         lambda b: run(F.slice(lengths, b * BLOCK + 1, BLOCK)))
    return blocks


def _flat_starts(blocks: Column) -> Column:
    """Block-wise sums of :func:`prefix_sums` joined into one array."""
    base = F.aggregate(blocks, F.array(F.lit(0)),
                       lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(b, -1))))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), F.slice(base, 1, F.size(blocks)).alias("s")),
                                 lambda x: F.transform(F.slice(x["b"], 1, F.size(x["b"]) - 1),
                                                       lambda v: v + x["s"])))


def found(df: DataFrame, text: str, pattern: str, out: str, group: int = 0) -> DataFrame:
    """Add ``out``: array of (start, end, value) of the leftmost non-overlapping matches. Starts
    follow from the lengths of the pieces between the matches."""
    hit, t = F.col(text).rlike(pattern), F.col(text)
    none = F.array().cast("array<string>")
    df = df.withColumn("_m", F.when(hit, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none)) \
        .withColumn("_v", F.when(hit, F.regexp_extract_all(t, F.lit(pattern), F.lit(group))).otherwise(none)
                    if group else F.col("_m"))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split(t, pattern, -1)).otherwise(none))
    # each step: the piece before a match and the match itself
    df = df.withColumn("_steps", F.zip_with(F.slice("_g", 1, F.size("_m")), F.col("_m"),
                                            lambda g, m: F.length(g) + F.length(m)))
    df = df.withColumn("_blocks", F.when(F.size("_m") > 0, prefix_sums(F.col("_steps"))))
    df = df.withColumn("_before", F.when(F.size("_m") > 0, _flat_starts(F.col("_blocks")))
                       .otherwise(F.array().cast("array<int>")))
    df = df.withColumn(out, F.transform(F.arrays_zip("_before", F.slice("_g", 1, F.size("_m")).alias("_g"), "_m", "_v"),
                                        lambda x: F.struct(
                                            (x["_before"] + F.length(x["_g"])).alias("start"),
                                            (x["_before"] + F.length(x["_g"]) + F.length(x["_m"])).alias("end"),
                                            x["_v"].alias("value"))))
    return df.drop("_m", "_v", "_g", "_steps", "_blocks", "_before")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id with the arrays assign, access, hex (base spans) and token (candidates)."""
    df = docs.select("doc_id", whole_text().alias("_text"))
    df = found(df, "_text", ASSIGN, "assign", 2)
    df = df.withColumn("assign", F.filter("assign", lambda s: F.length(s["value"]) >= LEAST_ASSIGN))
    df = found(df, "_text", ACCESS, "access")
    df = found(df, "_text", HEX, "hex")
    return found(df, "_text", TOKEN, "token").drop("_text")


def outside(spans: Column, base: Column) -> Column:
    """Spans that touch no base span."""
    return F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def codes(token: Column) -> Column:
    """Places of a token's characters in ``ALPHABET``, from 1; 0 for any other character."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def transitions(tokens: DataFrame) -> DataFrame:
    """(label, pair, n): how often a pair of neighbours occurs; pair is from * size + to, and 0 is
    no character of the alphabet."""
    size = len(ALPHABET) + 1
    pairs = tokens.withColumn("_c", codes(F.col("token"))).select("label", F.explode(
        F.zip_with(F.slice("_c", 1, F.size("_c") - 1), F.slice("_c", 2, F.size("_c") - 1),
                   lambda a, b: a * size + b)).alias("pair"))
    return pairs.groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n"))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios by pair from (label, token); label is ``random`` or ``ordinary``."""
    size = len(ALPHABET) + 1
    counts = {label: [SMOOTHING] * (size * size) for label in ("random", "ordinary")}
    for r in transitions(samples).collect():  # at most 2 * size² rows
        counts[r["label"]][r["pair"]] += r["n"]
    logs = {}
    for label, n in counts.items():
        logs[label] = []
        for a in range(size):
            row = n[a * size:(a + 1) * size]
            logs[label] += [math.log(x / sum(row)) for x in row]
    return [round(a - b, 4) for a, b in zip(logs["random"], logs["ordinary"])]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token: random against ordinary."""
    size = len(ALPHABET) + 1
    table = F.from_json(F.lit(str(model)), "array<double>")  # folded into one constant
    c = codes(token)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))
    return F.aggregate(c, start, lambda acc, x: F.struct(
        F.when(acc["last"] < 0, 0.0).otherwise(
            acc["sum"] + F.element_at(table, acc["last"] * size + x + 1)).alias("sum"),
        x.alias("last")))["sum"]


def held_out(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(HELD_OUT)) == 0


def mean_ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio a transition; a token of one character has none and scores 0."""
    return ratio(token, model) / F.greatest(F.length(token) - 1, F.lit(1))


def threshold(samples: DataFrame, model: list[float]) -> dict[str, float | None]:
    """Threshold of the mean ratio from (label, token), with the recall of random samples and the
    rate of false alarms among ordinary ones at it. It maximises their difference; of a range of
    equal ones it is the middle. Scores are counted in steps: at most some 800 rows are collected."""
    score = F.greatest(F.least(mean_ratio(F.col("token"), model), F.lit(WIDEST)), F.lit(-WIDEST))
    counts = samples.groupBy("label", F.floor(score / STEP).cast("int").alias("step")) \
        .agg(F.count(F.lit(1)).alias("n")).collect()
    n = {label: {r["step"]: r["n"] for r in counts if r["label"] == label} for label in ("random", "ordinary")}
    if not all(n.values()):
        return {"threshold": PRIOR, "recall": None, "false_alarms": None}
    last = int(WIDEST / STEP)
    best: list[tuple[float, int, float, float]] = []
    for t in range(-last, last + 1):
        recall, alarms = (sum(v for k, v in n[label].items() if k >= t) / sum(n[label].values())
                          for label in ("random", "ordinary"))
        if not best or recall - alarms >= best[0][0]:
            best = [x for x in best if x[0] == recall - alarms] + [(recall - alarms, t, recall, alarms)]
    _, t, recall, alarms = best[len(best) // 2]
    return {"threshold": t * STEP, "recall": recall, "false_alarms": alarms}


def learn(samples: DataFrame) -> tuple[list[float], dict[str, float | None]]:
    """Ratios by pair from the samples that are not held out, and what the held-out ones say."""
    model = train(samples.where(~held_out(F.col("token"))))
    return model, threshold(samples.where(held_out(F.col("token"))), model)


def labelled(hits: DataFrame) -> DataFrame:
    """(label, token) of every base value and of every token outside the base spans."""
    values = hits.select(F.lit("random").alias("label"), F.explode(F.concat(
        *[F.transform(k, lambda s: s["value"]) for k in KINDS[:3]])).alias("token"))
    return values.unionByName(hits.select(F.lit("ordinary").alias("label"), F.explode("token.value").alias("token")))


def hits_of(docs: DataFrame) -> DataFrame:
    """The stored scan with the candidate tokens that touch no base span."""
    base = F.concat(*[F.transform(k, lambda s: F.struct(s["start"], s["end"])) for k in KINDS[:3]])
    return saved(scan(docs), "secret-scan").withColumn("token", outside(F.col("token"), base))


def secrets(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    kinds = KINDS[:3]
    hits = hits_of(docs)
    model, chosen = learn(labelled(hits))
    judged = hits.withColumn("markov", F.filter("token", lambda s: mean_ratio(s["value"], model) >= chosen["threshold"]))

    def marked(kind):
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["end"].alias("end")))

    def marks(names):
        return F.array_join(F.transform(F.array_sort(F.concat(*map(marked, names))), lambda s: F.concat_ws(
            ":", F.element_at(F.array(*map(F.lit, KINDS)), s["order"] + 1), s["start"].cast("string"),
            s["end"].cast("string"))), ",")

    return judged.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(marks(kinds).cast("binary"), 256).alias("base_sha256"), marks(KINDS).alias("spans"))
