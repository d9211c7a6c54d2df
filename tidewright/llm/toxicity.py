"""Toxicity by a weighted finite-state pattern grammar.

Words become classes: insults (words and word stems learned from labelled rows), threats, targets,
negations and reporting verbs (short fixed lists). Small transducers rewrite a clause's classes one
after another (reported speech, negation, target, threat) and are composed into one machine. What it
accepts in each clause is summed with the insults' learned weights, and a logistic model over the sums
gives the score, so an insult at somebody weighs otherwise than a negated or a reported one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewright.llm.common import Scratch

#: Labelled rows that the lexicon and the weights are fitted on, at most; those with the smallest hashes.
FIT_ROWS = 20_000
#: Lengths of word stems; toxic documents and precision that a lexicon entry needs.
STEMS, SUPPORT, PRECISION = (4, 5, 6, 7), 5, 0.9
#: Distinct words whose classes a task remembers; forms that it counts before it hands them on; rows of text unpacked at once.
MEMORY, FORMS, ROWS = 100_000, 60_000, 256

#: Function words of the grammar, in English, German, French and Spanish.
TARGETS = "you your yours yourself he she they him her them his their du dich dir dein ihr euch sie er tu toi te vous votre il elle ils usted tu ti ustedes ellos"
THREATS = "kill hurt destroy beat punch shoot burn töten schlagen verletzen vernichten tuer frapper détruire matar golpear destruir"
NEGATIONS = "not no never isn't aren't wasn't nicht kein keine nie ne pas jamais nunca ni"
REPORTS = "said says say called calls wrote writes claimed quoted sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió"

WORD = re.compile(r"[^\W_]+(?:'[a-z]+)?")
CLAUSE = re.compile(r"[.!?;:\n|]+")
CLASSES = "OIYTNR"


def transducer(classes: str, states: int, rules: dict) -> dict:
    """A complete table (state, class) -> (state, class); what no rule names passes through and steps back."""
    return {(s, c): rules.get((s, c), (max(s - 1, 0), c)) for s in range(states) for c in classes}


def compose(one: dict, two: dict) -> dict:
    """The machine that feeds what ``one`` writes into ``two``."""
    return {((s, t), c): ((one[s, c][0], two[t, one[s, c][1]][0]), two[t, one[s, c][1]][1])
            for s, c in one for t in {t for t, _ in two}}


def machines() -> tuple[dict, dict, dict, dict]:
    """The transducers for reported speech, negation, targets and threats, in the order that they read one another.

    Written classes: I plain insult, q reported, n negated, U at a target, H threat at a target.
    """
    reported = transducer(CLASSES, 9, {(s, "R"): (8, "R") for s in range(9)} | {(s, "I"): (s - 1, "q") for s in range(1, 9)})
    letters = CLASSES + "q"
    negated = transducer(letters, 4, {(s, "N"): (3, "N") for s in range(4)} | {(s, "I"): (s - 1, "n") for s in range(1, 4)})
    letters += "n"
    aimed = transducer(letters, 7, {(s, "Y"): (6, "Y") for s in range(7)} | {(s, "I"): (s, "U") for s in range(1, 7)})
    letters += "U"
    threat = transducer(letters, 5, {(s, "T"): (4, "T") for s in range(5)} | {(s, "Y"): (s - 1, "H") for s in range(1, 5)})
    return reported, negated, aimed, threat


def grammar() -> tuple[list[list[int]], list[list[int]], str]:
    """Next states and outputs of the composed machine, and its output classes."""
    reported, negated, aimed, threat = machines()
    machine = compose(compose(compose(reported, negated), aimed), threat)
    start = (((0, 0), 0), 0)
    number, todo = {start: 0}, [start]
    follow, written, out = [], [], "OIYTNRqnUH"
    for state in todo:
        row, wrote = [], []
        for c in CLASSES:
            to, w = machine[state, c]
            if to not in number:
                number[to] = len(todo)
                todo.append(to)
            row.append(number[to])
            wrote.append(out.index(w))
        follow.append(row)
        written.append(wrote)
    return follow, written, out


def _held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _texts(column) -> Iterator[str | None]:
    """Texts of an Arrow column, unpacked a few at a time."""
    for first in range(0, len(column), ROWS):
        yield from column.slice(first, ROWS).to_pylist()


def _forms(word: str) -> list[str]:
    """A word as an entry, and its stems (marked by *)."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


def lexicon(fit: DataFrame, scratch: Scratch) -> dict[str, float]:
    """Words and stems that tell toxic documents: weights by entry.

    All come from ``fit``, at most FIT_ROWS rows, and each stands in SUPPORT of them at least, so what
    comes to the driver does not grow with the corpus. Documents are counted for each form, in tasks first. A stem that a shorter kept stem begins is
    dropped, and so is a word with a kept stem.
    """

    def run(batches):
        toxic, clean = Counter(), Counter()

        def rows():
            keys = list(toxic.keys() | clean.keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["form", "toxic", "clean"])
            toxic.clear()
            clean.clear()
            return out

        for batch in batches:
            for text, label in zip(_texts(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                forms = {f for w in set(WORD.findall((text or "").lower())) for f in _forms(w)}
                (toxic if label else clean).update(forms)
                if len(toxic) + len(clean) > FORMS:
                    yield rows()
        yield rows()

    counts = fit.select("text", "toxic").mapInArrow(run, "form string, toxic long, clean long")
    counts = counts.groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    good = counts.where((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean"))))
    found = good.collect()
    kept: dict[str, float] = {}
    for r in sorted(found, key=lambda r: (not r["form"].endswith("*"), len(r["form"]), r["form"])):
        form = r["form"].rstrip("*")
        if not any(form[:k] + "*" in kept for k in STEMS if k <= len(form)):
            kept[r["form"]] = float(np.log((r["toxic"] + 0.5) / (r["clean"] + 0.5)))
    return kept


class Tagger:
    """Clause machine with a lexicon: features of texts."""

    #: sums of weights: plain, reported, negated, targeted; threats; clauses with a match; distinct entries; rate
    FEATURES = 8

    def __init__(self, entries: dict[str, float]):
        self.entries = entries
        self.follow, self.written, self.out = grammar()
        self.classes = {w: (c, 0.0) for c, words in (("Y", TARGETS), ("T", THREATS), ("N", NEGATIONS), ("R", REPORTS)) for w in words.split()}
        self.known: dict[str, tuple] = {}

    def tag(self, word: str):
        hit = next((f for f in _forms(word) if f in self.entries), None)
        tag = ("I", self.entries[hit], hit) if hit else (*self.classes[word], word) if word in self.classes else None
        if len(self.known) >= MEMORY:
            self.known.clear()
        self.known[word] = tag
        return tag

    def features(self, text: str | None) -> list[float]:
        words = WORD.findall(text := (text or "").lower())
        known, missing = self.known, object()
        tags = [tag if (tag := known.get(w, missing)) is not missing else self.tag(w) for w in words]
        got = [0.0] * self.FEATURES
        if not any(t is not None and t[0] in "IT" for t in tags):
            return got
        sums = dict.fromkeys(self.out, 0.0)
        clauses, entries = 0, set()
        for clause in CLAUSE.split(text):
            state, matched = 0, False
            for w in WORD.findall(clause):
                tag = known.get(w, missing)
                if tag is missing:
                    tag = self.tag(w)
                c = CLASSES.index(tag[0]) if tag else 0
                wrote = self.out[self.written[state][c]]
                state = self.follow[state][c]
                if wrote == "H":
                    sums["H"] += 1
                    matched = True
                elif wrote in "IqnU":
                    sums[wrote] += tag[1]
                    matched = True
                    entries.add(tag[2])
            clauses += matched
        log = np.log1p
        return [*(float(log(sums[c])) for c in "IqnU"), float(log(sums["H"])), float(log(clauses)), float(log(len(entries))),
                float(log(100 * sum(sums[c] for c in "IqnU") / max(20, len(words))))]


def _fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge; the constant comes last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    return w


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The columns of ``docs`` with held_out, score (0 to 1) and predicted (1 if score >= threshold).

    Learns from rows of ``labels`` (doc_id, toxic) whose crc32(doc_id as text) mod 4 is not 2: at most
    FIT_ROWS of them, those with the smallest hashes of doc_id. Only the text enters a score. Null and
    empty texts get the score of a text without matches; null labels teach nothing; repeated rows count
    as often as they stand; without labelled rows of both kinds every score is the share of toxic rows.
    """
    scratch = Scratch(spark, "toxicity")
    taught = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic is not null").where(~_held_out())
    sample = scratch.keep(taught.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(FIT_ROWS), "sample")
    # At most FIT_ROWS pairs of numbers.
    fit = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")
    fit = scratch.keep(fit.select("text", "toxic").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "fit")
    entries = lexicon(fit, scratch)

    def features(batches):
        tagger = Tagger(entries)
        for batch in batches:
            x = [tagger.features(t) for t in _texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    rows = fit.select("text", "toxic").mapInArrow(features, "x array<double>, toxic int").collect()
    y = np.array([float(r["toxic"] > 0) for r in rows])
    if len(rows) and 0 < y.sum() < len(y):
        weights = _fit_weights(np.array([r["x"] for r in rows]), y)
    else:
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.1
        weights = np.append(np.zeros(Tagger.FEATURES), np.log(share / (1 - share)))

    # Columns go by place, so that none can clash; the text goes once, where it is a string already.
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    if dict(rows.dtypes)[text] != "string":
        rows, text = rows.withColumn("text", F.col(text).cast("string")), "text"
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])

    def scored(batches):
        tagger = Tagger(entries)
        for batch in batches:
            x = np.array([tagger.features(t) for t in _texts(batch.column(text))]).reshape(-1, Tagger.FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=schema.names)

    out = rows.mapInArrow(scored, schema)
    own = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in ("held_out", "score", "predicted")]
    held_out = _held_out(names[docs.columns.index("doc_id")])
    return out.select(*own, held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
